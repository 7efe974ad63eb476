"""Rule scores, their combination with a model's, and routing, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CATEGORIES, MISCELLANEOUS
from .automaton import Matcher, holds_word, laid_out

# Thresholds and weights.
AUTO, SOFT = 70.0, 40.0
KEYWORD, SENTENCE, FILENAME = 2, 5, 10
BASELINE = 50.0
#: Keywords and sentences that are looked for one by one at most.
MANY = 300
RULE_SHARE, AI_SHARE, DISAGREEMENT = 0.35, 0.65, 0.75


@dataclass(frozen=True)
class Rules:
    """Of each category, in order: keywords (whole words), sentences (substrings) and file name patterns."""

    categories: dict[str, dict[str, tuple[str, ...]]]
    baseline: float = BASELINE

    @staticmethod
    def of(said: dict, baseline: float = BASELINE) -> Rules:
        """From the parsed JSON; patterns that don't compile are left out."""
        out = {}
        for name, kinds in said.items():
            patterns = []
            for p in kinds.get("filename_patterns", ()):
                try:
                    re.compile(p)
                    patterns.append(p)
                except re.error:
                    continue
            out[name] = {"keywords": tuple(kinds.get("keywords", ())), "sentences": tuple(kinds.get("sentences", ())), "filename_patterns": tuple(patterns)}
        return Rules(out, baseline)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _count(conditions: list[Column]) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + c.cast("int")
    return total


def _keywords(low: Column, tokens: Column, words: tuple[str, ...]) -> Column:
    """How many keywords a text holds: plain words among its tokens, phrases as substrings, others between word ends."""
    words = tuple(w.lower() for w in words)
    plain = [w for w in words if re.fullmatch(r"\w+", w)]
    rest = [low.contains(w) if " " in w else low.rlike(rf"(?U)\b{re.escape(w)}\b") for w in words if not re.fullmatch(r"\w+", w)]
    found = F.size(F.filter(F.array(*map(F.lit, plain)), lambda w: F.array_contains(tokens, w))) if plain else F.lit(0)
    return found + _count(rest)


def text_signals(text: Column, rules: Rules) -> Column:
    """array<struct<category, ord, keywords, sentences>>, one entry a category in order.

    A text is lower-cased and parted into words once; of its words only those that some rule names are kept. Each pattern
    is an expression of its own: rule sets of more than `MANY` go to the automaton.
    """
    if sum(len(k["keywords"]) + len(k["sentences"]) for k in rules.categories.values()) > MANY:
        return matched_signals(text, rules)
    known = sorted({w.lower() for kinds in rules.categories.values() for w in kinds["keywords"] if re.fullmatch(r"\w+", w)})

    def counted(x: Column) -> Column:
        low, tokens = x["low"], x["tokens"]
        rows = [F.struct(F.lit(category).alias("category"), F.lit(i).alias("ord"), _keywords(low, tokens, kinds["keywords"]).alias("keywords"), _count([low.contains(s.lower()) for s in kinds["sentences"]]).alias("sentences")) for i, (category, kinds) in enumerate(rules.categories.items())]
        return F.array(*rows)

    def parted(low: Column) -> Column:
        tokens = F.array_intersect(F.split(low, r"(?U)\W+"), F.array(*map(F.lit, known))) if known else F.array().cast("array<string>")
        return F.struct(low.alias("low"), tokens.alias("tokens"))

    return bound(bound(F.lower(F.coalesce(text, F.lit(""))), parted), counted)


def matched_signals(text: Column, rules: Rules) -> Column:
    """The same as text_signals() by an automaton over whole batches, whose time doesn't depend on the number of rules.

    Equal patterns are looked for once. An empty sentence is in every text, an empty keyword in every text with a word.
    """
    wanted: dict[tuple[str, bool], int] = {}
    rows = []  # pattern, category, 0 for keywords and 1 for sentences; repeated rules count each time
    for i, kinds in enumerate(rules.categories.values()):
        each = [(w.lower(), " " not in w, 0) for w in kinds["keywords"]] + [(x.lower(), False, 1) for x in kinds["sentences"]]
        rows += [(wanted.setdefault((x, bounded), len(wanted)), i, kind) for x, bounded, kind in each]
    matcher = Matcher([x for x, _ in wanted], [b for _, b in wanted])
    counts = np.zeros((max(len(wanted), 1), max(len(rules.categories), 1), 2), np.int32)
    for pattern, category, kind in rows:
        counts[pattern, category, kind] += 1
    weights, (always, worded) = counts.reshape(len(counts), -1), (wanted.get(("", b)) for b in (False, True))
    # Most patterns are one category's: the places and numbers of each pattern's entries.
    at, slot = np.nonzero(weights)
    first = np.searchsorted(at, np.arange(len(weights) + 1))
    value = weights[at, slot]
    names = list(rules.categories)

    @F.arrow_udf("array<struct<category:string,ord:int,keywords:int,sentences:int>>")
    def matched(texts: pa.Array) -> pa.Array:
        out = np.zeros((len(texts), 2 * len(names)), np.int32)
        for low, data, offsets in laid_out(texts):
            text, pattern = matcher.found(data, offsets)
            if always is not None:
                text, pattern = np.concatenate([text, np.arange(len(offsets) - 1)]), np.concatenate([pattern, np.full(len(offsets) - 1, always)])
            if worded is not None:
                held = np.flatnonzero([holds_word(bytes(data[a:b]).decode()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                text, pattern = np.concatenate([text, held]), np.concatenate([pattern, np.full(len(held), worded)])
            size = first[pattern + 1] - first[pattern]
            entry = np.repeat(first[pattern] - np.cumsum(size) + size, size) + np.arange(size.sum())
            np.add.at(out, (low + np.repeat(text, size), slot[entry]), value[entry])
        flat = out.reshape(-1, 2)
        rows = len(texts)
        items = pa.StructArray.from_arrays([pa.array(names * rows, pa.string()), pa.array(np.tile(np.arange(len(names), dtype=np.int32), rows)), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["category", "ord", "keywords", "sentences"])
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * len(names)), items)

    return matched(F.lower(F.coalesce(text, F.lit(""))))


def name_signals(name: Column, rules: Rules) -> Column:
    """array<int>: of each category in order, how many of its patterns the file name matches."""
    file = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[_\-]", " ")
    return bound(file, lambda file: F.array(*[_count([file.rlike(f"(?i){p}") for p in kinds["filename_patterns"]]) for kinds in rules.categories.values()]))


def joined_signals(texts: Column, names: Column, rules: Rules) -> Column:
    """array<struct<category, ord, keywords, sentences, filenames, raw, score>> of text_signals and name_signals."""

    def scored(x: Column) -> Column:
        score = F.round(F.least(x["raw"] / F.lit(rules.baseline) * 100, F.lit(100.0)), 2)
        return F.struct(*[x[c].alias(c) for c in ("category", "ord", "keywords", "sentences", "filenames", "raw")], score.alias("score"))

    def weighed(t: Column, f: Column) -> Column:
        raw = t["keywords"] * KEYWORD + t["sentences"] * SENTENCE + f * FILENAME
        return F.struct(t["category"].alias("category"), t["ord"].alias("ord"), t["keywords"].alias("keywords"), t["sentences"].alias("sentences"), f.alias("filenames"), raw.alias("raw"))

    return F.transform(F.zip_with(texts, names, weighed), scored)


def signals(text: Column, name: Column, rules: Rules) -> Column:
    """Both kinds of signals of one document; each pattern is looked for once."""
    return joined_signals(text_signals(text, rules), name_signals(name, rules), rules)


def all_scores(found: Column) -> Column:
    """The score of every category as a JSON object."""
    return F.to_json(F.map_from_arrays(F.transform(found, lambda x: x["category"]), F.transform(found, lambda x: x["score"])))


def winner(found: Column) -> Column:
    """The best category: by score, then matched signals, file names, sentences, keywords, then order.

    All zero gives the first category.
    """
    ranked = F.transform(found, lambda x: F.struct(x["score"].alias("score"), (x["keywords"] + x["sentences"] + x["filenames"]).alias("n"), x["filenames"], x["sentences"], x["keywords"], (-x["ord"]).alias("rank"), x["category"].alias("category")))
    return F.array_max(ranked)


def status_of(score: Column) -> Column:
    return F.when(score >= AUTO, "auto_classified").when(score >= SOFT, "soft_flag").otherwise("hard_stop")


def combine(rule: Column, rule_category: Column, ai: Column, ai_category: Column) -> Column:
    """struct<combined_score, final_category, status, categories_agreed>."""
    agreed = rule_category == ai_category
    score = F.round(F.least(F.when(agreed, rule * RULE_SHARE + ai * AI_SHARE).otherwise(F.greatest(rule, ai) * DISAGREEMENT), F.lit(100.0)), 2)
    category = F.when(agreed | (ai >= rule), ai_category).otherwise(rule_category)
    return F.struct(score.alias("combined_score"), category.alias("final_category"), status_of(score).alias("status"), agreed.alias("categories_agreed"))


def validated(category: Column, score: Column) -> Column:
    """A model's answer made safe: struct<category, score>; an unknown category becomes the first, 20 points lower."""
    known = F.coalesce(category, F.lit("")).isin(*CATEGORIES, MISCELLANEOUS)
    number = score.try_cast("double")
    low = F.greatest(F.lit(0.0), F.coalesce(number, F.lit(10.0)) - 20)
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return F.struct(F.when(known, category).otherwise(F.lit(CATEGORIES[0])).alias("category"), clamp(F.when(known, F.coalesce(number, F.lit(0.0))).otherwise(low)).alias("score"))


# The notes that records carry.
def zero_reason(empty: Column) -> Column:
    start = "Auto-routed to Miscellaneous: zero confidence score. "
    return F.when(empty, start + "No text was extracted from the document (possible scanned/image-based PDF) and no filename pattern matched any of the 5 active categories. Cannot classify without readable content.").otherwise(
        start + "Document text was readable but contained no keywords, sentences, or filename patterns matching any of the 5 active categories (" + ", ".join(CATEGORIES) + "). Document likely belongs to a category outside the active set."
    )


def ai_miscellaneous_reason(score: Column, reasoning: Column) -> Column:
    from .text import percent

    return F.concat(F.lit("Auto-routed to Miscellaneous: AI classifier determined document does not belong to any of the 5 active categories. AI confidence: "), percent(score, 1), F.lit("%. AI reasoning: "), F.coalesce(reasoning, F.lit("No reasoning provided.")))


def route(rule: Column, rule_category: Column, ai: Column, ai_category: Column, ai_reasoning: Column, empty: Column) -> Column:
    """Where a document goes: struct of tier, status, category, score, kind and notes.

    Zero goes to Miscellaneous, 70 and over is settled by rules; in between the model is asked. An empty text has a
    model's answer of its own (first category, 0); no answer leaves the rules' score to a person.
    """
    asks = (rule > 0) & (rule < AUTO)
    ai = F.when(empty, F.lit(0.0)).otherwise(ai)
    ai_category = F.when(empty, F.lit(CATEGORIES[0])).otherwise(ai_category)
    misc = ai_category == MISCELLANEOUS
    both = combine(rule, rule_category, ai, ai_category)
    case = F.when(rule == 0, "zero").when(~asks, "rule").when(ai_category.isNull(), "failed").when(misc, "misc").otherwise("both")
    status = F.when(case.isin("zero", "misc"), "auto_miscellaneous").when(case == "rule", "auto_classified").when(case == "failed", F.when(rule >= SOFT, "soft_flag").otherwise("hard_stop")).otherwise(both["status"])
    category = F.when(case.isin("zero", "misc"), MISCELLANEOUS).when(case == "both", both["final_category"]).otherwise(rule_category)
    score = F.when(case == "misc", ai).when(case == "both", both["combined_score"]).otherwise(rule)
    kind = F.when(case == "zero", "auto_miscellaneous").when(case == "rule", "rule_based").when(case == "failed", "rule_based + human_in_the_loop").when((case == "misc") | (status == "auto_classified"), "rule_based + ai").otherwise("rule_based + ai + human_in_the_loop")
    notes = F.when(case == "zero", zero_reason(empty)).when(case == "misc", ai_miscellaneous_reason(ai, ai_reasoning))
    return F.struct(
        F.when(asks, "rule_and_ai").otherwise("rule_only").alias("classification_tier"), status.alias("classification_status"), category.alias("final_category"), score.alias("combined_confidence_score"), kind.alias("type_of_classification"), notes.alias("classification_notes"),
        F.when(asks, ai_category).alias("ai_predicted_category"), F.when(asks & ai_category.isNotNull(), ai).alias("ai_confidence_score"),
    )
