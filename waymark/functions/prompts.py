"""Prompt texts and their composition from sample columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that models were trained with.
VERSION = "v3"
INSTRUCTION = "Here is a record of a user's POI accesses, your task is based on the history to predict the POI that the user is likely to access at the specified time."
NO_HISTORY = "No historical trajectory is available."
NO_CASE = "No retrieved case is available."
ONE = {"id": "You are a helpful assistant for next POI prediction. Reply with POI IDs only.", "sid": "You are a helpful assistant for next POI prediction. Reply with semantic IDs only."}
TEN_ID = (
    "You are a next-POI prediction assistant. Reply with exactly 10 POI IDs in descending likelihood order. Output one line only. Separate IDs with a single space. "
    "Do not output explanations, numbering, commas, or duplicate IDs. Start immediately with the first POI ID."
)
TEN_SID = (
    "You are a next-POI prediction assistant. A complete semantic ID must look like <a_1><b_2><c_3> or <a_1><b_2><c_3><d_0>. "
    "Reply with exactly 10 complete semantic IDs in descending likelihood order. Output one line only. Separate IDs with a single space. "
    "Do not output explanations, numbering, commas, or duplicate IDs. Start immediately with the first semantic ID."
)
FORMAT_ID = """Output format:
1. Return exactly {n} candidate POI IDs in one line.
2. Use descending likelihood order.
3. Each candidate must use the POI ID format like <123>.
4. Separate candidates with a single space only.
5. Do not output explanations, numbering, commas, or any extra text.
6. Do not repeat candidates."""
FORMAT_SID = """Output format:
1. A complete semantic ID must look like <a_1><b_2><c_3> or <a_1><b_2><c_3><d_0>.
2. You must return exactly {n} complete semantic IDs.
3. Use descending likelihood order.
4. Output one line with single spaces only.
5. Do not output explanations, numbering, commas, or duplicate IDs."""
MORE = {"id": "\n7. Start the reply immediately with the first POI ID.", "sid": "\n6. Start the reply immediately with the first semantic ID."}
TASKS = {
    "a_to_category_profile": "Given a semantic prefix, output its category profile JSON.",
    "category_profile_to_a": "Given a category profile JSON and candidate prefixes, output the single matching semantic prefix.",
    "ab_to_category_region_profile": "Given a semantic prefix, output its category-region profile JSON.",
    "category_region_profile_to_ab": "Given a category-region profile JSON and candidate prefixes, output the single matching semantic prefix.",
    "abc_to_abc_profile": "Given a semantic prefix, output its semantic profile JSON.",
    "abc_profile_to_abc": "Given a semantic profile JSON and candidate prefixes, output the single matching semantic prefix.",
    "full_sid_to_abc_profile": "Given a full semantic ID, output the semantic core profile JSON for its abc prefix.",
}


def requirements(kind: str, n: int = 10) -> str:
    body = (FORMAT_ID if kind == "id" else FORMAT_SID).format(n=n)
    return body + (MORE[kind] if n != 1 else "" if kind == "id" else "\nExample: <a_1><b_2><c_3>")


def system(kind: str, n: int = 10) -> str:
    return ONE[kind] if n == 1 else TEN_ID if kind == "id" else TEN_SID


def history(text: Column) -> Column:
    return F.concat(F.lit("Historical trajectory:\n"), F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_HISTORY)))


def case(rank: Column, key_text: Column, target: Column) -> Column:
    return F.concat(F.lit("Case "), rank.cast("string"), F.lit(":\nTrajectory: "), key_text, F.lit("\nNext POI: "), target)


def cases(rendered: Column) -> Column:
    """From an array of rendered cases in order."""
    body = F.when(F.size(rendered) > 0, F.array_join(rendered, "\n\n")).otherwise(F.lit(NO_CASE))
    return F.concat(F.lit("Retrieved similar cases:\n"), F.coalesce(body, F.lit(NO_CASE)))


def current(input_text: Column, key_text: Column, target_time: Column) -> Column:
    return F.coalesce(F.nullif(input_text, F.lit("")), F.concat(key_text, F.lit("\nPrediction time: "), target_time))


def body(source: str, now: Column, past: Column | None = None, similar: Column | None = None) -> Column:
    """The input of a history source: current, original, retrieval or hybrid."""
    sections = [past] if source in ("original", "hybrid") else []
    sections += [similar] if source in ("retrieval", "hybrid") else []
    return F.concat_ws("\n\n", *sections, now)


def prompt(input_body: Column, kind: str, n: int = 10) -> Column:
    """The whole prompt; one candidate, the supervised form, has no requirements."""
    sections = [F.lit("### Instruction:\n" + INSTRUCTION), F.concat(F.lit("### Input:\n"), input_body)]
    return F.concat_ws("\n\n", *sections, *([F.lit(requirements(kind, n))] if n != 1 else []))


def alignment(instruction: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("### Instruction:\n"), F.trim(instruction)), F.concat(F.lit("### Input:\n"), F.trim(text)), F.lit("### Response:\n"))
