"""Rounds of rankings, answers that cannot be used, and retries."""

import json

import pytest
from pyspark.sql import functions as F

from lumisift.models import ModelError
from lumisift.operators import tournament
from lumisift.plans import stage2, suite
from lumisift.sinks import outputs


def ranker(most, leave_out=(), broken=()):
    """A model that ranks by name, last first, and refuses longer prompts."""

    class Model:
        def __call__(self, prompt, images, schema=None):
            names = [x.strip() for x in prompt.rpartition(": ")[2].split(",")]
            if len(names) > most:
                raise ModelError(f"{len(names)} names", 400)
            if any(n in broken for n in names):
                return "no idea"
            best = sorted((n for n in names if n not in leave_out), reverse=True)
            return json.dumps({
                "top_batch_filenames": best, "ranked_filenames": ["ghost", *best, *best[:1]], "top_filename": best[-1] if best else None,
                "photos": [{"filename": n, "printworthy_score": 5} for n in names], "reasons": [{"filename": n, "reason": f"of {len(names)}"} for n in best],
            })

    return Model


def finalists(spark, n):
    return spark.range(n).select(F.format_string("p%05d", "id").alias("filename"), (F.col("id") + 1).alias("final_place"))


def expected(n, size, top_n, leave_out=()):
    """The rounds in plain Python."""
    rows, done, back = [f"p{i:05d}" for i in range(n)], [], 0
    while True:
        groups = [rows[i:i + size] for i in range(0, len(rows), size)]
        ranked = [sorted((x for x in g if x not in leave_out), reverse=True) or g for g in groups]
        if len(groups) == 1:
            done += [(-back, k, 0, x) for k, x in enumerate(ranked[0])]
            return [x for *_, x in sorted(done)][:top_n]
        keep = max(1, size // 4)
        done += [(-back, k, j, x) for j, g in enumerate(ranked) for k, x in enumerate(g) if k >= keep]
        rows, back = [x for g in ranked for x in g[:keep]], back + 1


@pytest.mark.parametrize("n, batch, top_n", [(5, 2, 5), (8, 2, 3), (9, 2, 9), (200, 2, 150), (65, 1, 65)])
def test_rounds_hold_no_more_than_a_prompt(spark, n, batch, top_n):
    c = stage2.Stage2Config(batch_size=batch, strict=True)
    ranking, top = stage2.rank_finalists(finalists(spark, n), ranker(c.prompt_size), top_n, c)
    got = [r.filename for r in ranking.orderBy("rank").collect()]
    assert got == expected(n, c.prompt_size, top_n) and len(got) == top_n
    assert top  # a name of the last prompt, ranked or not


def test_names_that_answers_leave_out(spark):
    c = stage2.Stage2Config(batch_size=2)
    out = ("p00003", "p00011", "p00030")
    ranking, _ = stage2.rank_finalists(finalists(spark, 40), ranker(8, leave_out=out), 40, c)
    got = [r.filename for r in ranking.orderBy("rank").collect()]
    assert got == expected(40, 8, 40, out) and not set(out) & set(got)
    # an unreadable answer leaves its group in the order of places
    ranking, top = stage2.rank_finalists(finalists(spark, 6), ranker(8, broken=("p00002",)), 4, c)
    assert [r.filename for r in ranking.orderBy("rank").collect()] == [f"p{i:05d}" for i in range(4)] and top == "p00000"


def test_group_ranks(spark):
    entrants = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "d", 3), (1, "e", 4)], "group int, filename string, place int")
    answers = spark.createDataFrame([(0, ["x", "c", "a", "c"], "b"), (1, ["a"], None)], "group int, ranked array<string>, top string")
    ranked = tournament.group_ranks(entrants, answers, 2)
    assert sorted((r.group, r.rank, r.filename) for r in ranked.collect()) == [(0, 1, "c"), (0, 2, "a"), (1, 1, "d"), (1, 2, "e")]
    assert sorted(map(tuple, tournament.group_tops(entrants, ranked, answers).collect())) == [(0, "b"), (1, "d")]


def test_smaller_batches_after_a_failure(spark):
    survivors = spark.range(40).select(F.format_string("p%05d", "id").alias("filename"))
    with pytest.raises(ModelError):
        stage2.rank_portfolio(survivors, ranker(7), stage2.Stage2Config(strict=True))
    ranked, size = stage2.rank_with_smaller_batches(survivors, ranker(6), stage2.Stage2Config(final_batches=1))
    assert size == 6 and ranked.count() == 10
    with pytest.raises(ModelError):
        stage2.rank_with_smaller_batches(survivors, ranker(2), stage2.Stage2Config(final_batches=1))


def test_a_large_family_is_not_copied_into_its_rows(spark):
    rows = spark.range(5000).select(F.lit(1).alias("scene_family_id"), F.format_string("p%05d", "id").alias("filename"))
    answers = spark.createDataFrame([(1, [f"p{i:05d}" for i in (9, 7, 9, 8)], "p00007", [("p00007", "x"), ("p00007", None), ("p00008", "y")])], "scene_family_id int, keep array<string>, primary string, photos array<struct<filename:string,reason:string>>")
    plan = tournament.family_plan(rows, 2500)
    out = tournament.model_decisions(plan, answers)
    assert "collect_set" not in out._jdf.queryExecution().executedPlan().toString()
    kept = {r.filename: (r.is_primary, r.reason) for r in out.where("kept").collect()}
    assert kept == {"p00009": (False, ""), "p00007": (True, "")} and out.count() == 5000


def test_a_suite_of_models_writes_its_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = []
    for i in range(30):
        path = tmp_path / "in" / f"p{i:05d}.jpg"
        path.write_bytes(str(i).encode())
        rows.append((path.name, str(path), i // 10, i % 10, 1))
    selected = spark.createDataFrame(rows, "filename string, source_path string, scene_family_id int, group_id int, group_size int")
    c = stage2.Stage2Config(batch_size=4)
    models = {"Good/Model 1": ranker(99), "Bad:model": ranker(0)}
    runs = {r.model: r for r in suite.run_suite(selected, models, str(tmp_path / "out"), c, str(tmp_path / "answers")).collect()}
    good = tmp_path / "out" / "good_model_1"
    assert runs["Bad:model"].error and runs["Good/Model 1"].error is None and runs["Good/Model 1"].families == 3
    document = lambda p: json.loads("".join(x.read_text() for x in sorted(p.glob("part-*"))))
    families, portfolio = document(good / "family_summary"), document(good / "portfolio_summary")
    assert families["family_count"] == 3 and families["input_count"] == 30 and [f["scene_family_id"] for f in families["families"]] == [0, 1, 2]
    assert [d["rank"] for d in portfolio["ranked_details"]] == list(range(1, runs["Good/Model 1"].ranked + 1)) and portfolio["top_filename"] == runs["Good/Model 1"].top_filename
    assert sorted(p.name for p in (good / "families").iterdir()) == [f"family_{i:04d}.json" for i in range(3)]
    copied = sorted(p.name for p in (good / "ranked").iterdir())
    assert len(copied) == runs["Good/Model 1"].ranked and copied[0].startswith("01_p")
    assert len(json.loads(json.loads((tmp_path / "out" / "suite_summary.json").read_text())["settings"])) > 5
    again = suite.run_suite(selected, {"Good/Model 1": ranker(0)}, str(tmp_path / "out"), c, str(tmp_path / "answers")).first()
    assert again.error is None and again.ranked == runs["Good/Model 1"].ranked  # every answer is known
    with pytest.raises(ValueError):
        suite.selected_photos(spark, [])


def test_lines_of_a_document_without_items(spark):
    head = spark.createDataFrame([(1, None)], "n int, x string")
    none = spark.createDataFrame([], "k int, v string")
    lines = outputs.document_lines(head, {"a": (none, "k"), "b": (spark.createDataFrame([(2, "y"), (1, None)], "k int, v string"), "k")})
    text = "".join(r.line for r in lines.orderBy("part", "place").collect())
    assert json.loads(text) == {"n": 1, "x": None, "a": [], "b": [{"k": 1, "v": None}, {"k": 2, "v": "y"}]}
