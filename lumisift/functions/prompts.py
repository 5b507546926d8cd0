"""Prompts for models, assembled from columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lenient_json import SIDES
from .text import drop_rotation, joined_unique, strip, stripped


@dataclass(frozen=True)
class Repair:
    """A repair mode: when it applies, what may change and what may not. A mode
    without ``change`` adds nothing to a prompt."""

    when: str
    change: str = ""
    leave: str = ""


#: The modes' names are fixed values; pass another table for other wording.
REPAIRS = {
    "edge_completion": Repair("the subject runs out of the frame", "the soft margin, which is still to be painted", "all inside the sharp frame"),
    "square_and_level": Repair("lines that ought to be level or parallel are not", "the tilt and the angles", "the crop and what it shows"),
    "crowd_cleanup": Repair("bystanders hide what the picture is about", "the bystanders nearest to the camera", "companions, far figures and the place"),
    "subject_deblur": Repair("the person meant is less sharp than the rest", "the softness of that person", "who they are, how they stand and look"),
    "tonal_only": Repair("nothing of the above"),
}


def _line(head: str, items: Column) -> Column:
    """A line of what remains of ``items``, or null if nothing does."""
    kept = joined_unique(items, "")
    return F.when(kept != "", F.concat(F.lit(head), kept))


def improvement_prompt(name: Column, goal: Column, safe: Column, conditional: Column, avoid: Column, risks: Column, mode: Column, sides: Column, repairs: dict[str, Repair] | None = None) -> Column:
    """The prompt of one image: what its mode may change, and its hints, each
    only if there is one. Requests to rotate never reach it. An unknown mode
    counts as ``tonal_only``."""
    repairs = REPAIRS if repairs is None else repairs
    tasks = {k: f"Change {r.change}. Leave {r.leave} as it is." if r.change else "" for k, r in repairs.items()}
    known = F.when(mode.isin(*repairs), mode).otherwise("tonal_only")
    task = F.nullif(F.element_at(F.create_map(*[F.lit(x) for kv in tasks.items() for x in kv]), known), F.lit(""))
    margins = F.when(F.size(sides) > 0, F.concat(F.lit("Margins were added on these sides and must read as the same scene: "), F.array_join(sides, ", "), F.lit(".")))
    asked = F.nullif(strip(goal), F.lit(""))
    return F.concat_ws(
        "\n", F.concat(F.lit("Prepare "), name, F.lit(" for print. It stays the same photograph: people, buildings, lettering and light are given.")),
        margins, task, F.when(asked.isNotNull(), F.concat(F.lit("Goal: "), asked)), _line("Welcome: ", drop_rotation(safe)), _line("If needed: ", drop_rotation(conditional)),
        _line("Never: ", stripped(avoid)), _line("Beware: ", stripped(risks)),
    )


def analysis_prompt(repairs: dict[str, Repair] | None = None, sides: tuple[str, ...] = SIDES) -> str:
    """The instruction of the model that picks a repair mode."""
    repairs = REPAIRS if repairs is None else repairs
    modes = "; ".join(f"{k} if {r.when}" for k, r in repairs.items())
    return f"Reply in JSON: repair_mode, the first that applies of {modes}; pad_sides, for the first mode alone, of {', '.join(sides)}; reason, a sentence."


def family_prompt(names: Column, limit: Column) -> Column:
    return F.concat(F.lit("These photographs show one scene. Keep at most "), limit.cast("string"), F.lit(" and answer in JSON with keep_filenames, primary_filename and photos: "), F.array_join(names, ", "))


def batch_prompt(names: Column, top: Column) -> Column:
    return F.concat(F.lit("Score each photograph from 1 to 10 for print and name the best "), top.cast("string"), F.lit(" in JSON: "), F.array_join(names, ", "))


def final_prompt(names: Column, n: Column) -> Column:
    return F.concat(F.lit("Rank the best "), n.cast("string"), F.lit(" of these finalists in JSON with ranked_filenames, top_filename and reasons: "), F.array_join(names, ", "))


def print_prompt(goal: Column, safe: Column, conditional: Column, avoid: Column, risks: Column) -> Column:
    """One line for a printer from a photo's score; null if it says nothing."""
    said = F.concat_ws("; ", F.nullif(strip(goal), F.lit("")), _line("do ", safe), _line("perhaps ", conditional), _line("avoid ", avoid), _line("mind ", risks))
    return F.nullif(said, F.lit(""))


def writer_prompt(analysis: Column, custom: Column) -> Column:
    """The request to a chat model that writes an edit prompt from an analysis
    and a user's wish; null without both."""
    parts = F.concat_ws("\n", F.concat(F.lit("Wish: "), F.nullif(F.trim(custom), F.lit(""))), F.concat(F.lit("Analysis: "), F.nullif(F.trim(analysis), F.lit(""))))
    return F.when(parts != "", F.concat(F.lit("Write one prompt for an image editor, at most five sentences, from this.\n"), parts))


def written_or(response: Column, local: Column) -> Column:
    """What the chat model wrote, or the local prompt if it wrote nothing."""
    return F.coalesce(F.nullif(strip(response), F.lit("")), local)


EDIT_MODES = {
    "selective": "Edit only the background; the subject ({subject}) stays exactly as it is. Task: {custom}",
    "ultra": "{custom}\nNothing about the subject may change: face, skin, hair, body, clothes, belongings, expression or gaze.",
    "plain": "{custom}",
}


def quick_fix_prompt(analysis: Column, custom: Column, mode: str = "plain", subject: str = "the main subject") -> Column:
    """A user's request in its mode's words, followed by the analysis; either
    may be null, without both the result is null."""
    before, after = EDIT_MODES[mode].replace("{subject}", subject).split("{custom}")
    asked = F.when(F.nullif(F.trim(custom), F.lit("")).isNotNull(), F.concat(F.lit(before), F.trim(custom), F.lit(after)))
    guard = F.concat(F.rtrim(analysis), F.lit(" Do not alter the main subject's face, and remove people in the background who are not the subject."))
    both = F.concat(asked, F.lit("\n\n---\n## Analysis (apply what agrees with the above):\n"), guard)
    return F.coalesce(both, asked, guard)
