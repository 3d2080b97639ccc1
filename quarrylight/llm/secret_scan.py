"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Everything is DataFrame expressions. A pattern's matches come from regexp_extract_all, their places
from the lengths of the pieces that split() leaves between them; both are computed only for texts
that need them, and only matches (few) go through lambda functions.

Candidate strings of a character class are runs of its letters of at least WINDOW letters. A window
slides over the candidate; the counts of its letters change by one letter out and one in, and with
them the sum of c log2 c, from which the window's entropy follows. A candidate with a window at or
above the class's bound is a span, unless an allow-list pattern fits it. Entropies are compared as
whole numbers (c log2 c in units of 2^-20), so that every engine finds the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.session import evaluate_once

#: The patterns of the base kinds, in the order in which ties are listed. A run that is
#: too short holds no longer run, so the least length of the last two stands in their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

#: Letters of a window.
WINDOW = 20
SCALE = 1 << 20


@dataclass(frozen=True)
class Charset:
    """A character class: its letters, the candidates' pattern and the least entropy in bits."""

    kind: str
    letters: str
    pattern: str
    bits: float


HEX_LETTERS = "0123456789abcdefABCDEF"
BASE64_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Word-like strings of 20 letters stay below 3.7 bits; random base64 has 3.8 to 4.3, random hex 3.1 to 3.8.
CLASSES = (
    Charset("entropy_hex", HEX_LETTERS, f"[0-9a-fA-F]{{{WINDOW},}}", 3.1),
    Charset("entropy_base64", BASE64_LETTERS, f"[A-Za-z0-9+/_-]{{{WINDOW},}}", 3.75),
)
#: Candidates that are no secrets (whole-string patterns): letters alone are words; a UUID names a thing; documentation keys.
ALLOWED = (
    r"[A-Za-z]+", r"[a-z]+([-_/][a-z]+)*", r"[0-9]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r".*(EXAMPLE|example|ABCDEFGHIJ|abcdefghij).*",
)


def _weights() -> list[int]:
    """c log2 c for counts c of a window, in whole units."""
    return [0, *(round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1))]


def most_weight(bits: float) -> int:
    """The largest sum of c log2 c of a window whose entropy is at least `bits`."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def _places(text: Column, pattern: str, found: Column) -> Column:
    """(start, end, match) of each match in code points, end exclusive; empty where nothing was found."""
    none = "array<struct<start:bigint,end:bigint,match:string>>"
    begin = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast(none).alias("all"), F.split(text, pattern, -1).alias("gaps")
    )

    def step(state: Column, i: Column) -> Column:
        match = F.element_at(found, i)
        start = state["at"] + F.length(F.element_at(state["gaps"], i))
        end = start + F.length(match)
        place = F.struct(start.alias("start"), end.alias("end"), match.alias("match"))
        return F.struct(end.alias("at"), F.concat(state["all"], F.array(place)).alias("all"), state["gaps"].alias("gaps"))

    located = F.aggregate(F.sequence(F.lit(1), F.size(found)), begin, step, lambda state: state["all"])
    return F.when(F.size(found) > 0, located).otherwise(F.array().cast(none))


def _least_weight(candidate: Column, letters: str) -> Column:
    """The smallest sum of c log2 c over all windows of a candidate, by incremental counts."""
    weights = F.array(*[F.lit(w).cast("long") for w in _weights()])
    weight = lambda count: F.get(weights, count)
    window = F.substring(candidate, 1, WINDOW)
    counts = F.transform(
        F.array(*[F.lit(x) for x in letters]),
        lambda letter: F.lit(WINDOW) - F.length(F.replace(window, letter, F.lit(""))),
    )
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda sum_, c: sum_ + weight(c))
    begin = F.struct(
        F.split(candidate, "").alias("text"), counts.alias("counts"), total.alias("now"), total.alias("least")
    )
    number = lambda letter: F.instr(F.lit(letters), letter) - 1

    def step(state: Column, i: Column) -> Column:
        gone, come = number(F.get(state["text"], i - WINDOW)), number(F.get(state["text"], i))
        less, more = F.get(state["counts"], gone), F.get(state["counts"], come)
        moved = F.when(gone == come, state["now"]).otherwise(
            state["now"] - weight(less) + weight(less - 1) - weight(more) + weight(more + 1)
        )
        changed = F.when(gone == come, state["counts"]).otherwise(F.transform(
            state["counts"], lambda c, k: F.when(k == gone, c - 1).when(k == come, c + 1).otherwise(c)
        ))
        return F.struct(
            state["text"].alias("text"), changed.alias("counts"), moved.alias("now"),
            F.least(state["least"], moved).alias("least"),
        )

    later = F.filter(F.sequence(F.lit(WINDOW), F.greatest(F.length(candidate) - 1, F.lit(WINDOW))),
                     lambda i: i < F.length(candidate))
    return F.aggregate(later, begin, step, lambda state: state["least"])


def _telling(c: Charset, allowed: tuple[str, ...]):
    """Whether a candidate of a class is no allowed string and has a window of high entropy."""
    suppressed = "^(?:" + "|".join(allowed) + ")$"
    return lambda x: ~x["match"].rlike(suppressed) & (_least_weight(x["match"], c.letters) <= most_weight(c.bits))


def _listed(places: Column, kind: str, order: int) -> Column:
    return F.transform(places, lambda x: F.struct(
        x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")
    ))


def scan(docs: DataFrame, classes: tuple[Charset, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """`docs` with the columns base_spans and entropy_spans: arrays of (start, order, end, kind).

    Base spans are the leftmost non-overlapping matches of each base kind, short ones dropped;
    entropy spans are added by the window scan. Each array is in the order of start, then kind.
    Null and empty texts have empty arrays; repeated rows are scanned each on its own. Other columns
    stay; if `docs` has one of the two names already, its column is replaced.
    """
    docs = docs.drop("base_spans", "entropy_spans")
    text = F.col("__text")
    base = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    patterns = base | {c.kind: c.pattern for c in classes}
    read = evaluate_once(docs, {"__text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    found = evaluate_once(read, {
        f"__{kind}": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)) for kind, pattern in patterns.items()
    })
    placed = {kind: _places(text, pattern, F.col(f"__{kind}")) for kind, pattern in patterns.items()}
    placed["assign"] = F.filter(placed["assign"], lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 8)
    for c in classes:
        placed[c.kind] = F.filter(placed[c.kind], _telling(c, allowed))
    spans = evaluate_once(found, {
        "base_spans": F.array_sort(F.concat(*[_listed(placed[k], k, i) for i, k in enumerate(base)])),
        "entropy_spans": F.array_sort(F.concat(*[
            _listed(placed[c.kind], c.kind, i + len(base)) for i, c in enumerate(classes)
        ])),
    })
    return spans.drop("__text", *[f"__{kind}" for kind in patterns])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def every(base: str = "base_spans", added: str = "entropy_spans") -> Column:
    return F.array_sort(F.concat(F.col(base), F.col(added)))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of the text replaced by a mark, overlapping spans by one.

    Texts without a span stay as they are, nulls included; a column n_chars, if there is one, gets
    the new length of changed texts. No row goes. Columns and their order are those of `docs`.
    """
    found = scan(docs)
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"),
                                                   (x["start"] - state["at"]).cast("int")), F.lit(mark))
        return F.struct(
            F.greatest(state["at"], x["end"]).alias("at"),
            F.when(x["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
        )

    whole = F.aggregate(
        every(), begin, step,
        lambda s: F.concat(s["out"], F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.length("text"))),
    )
    some = (F.size("base_spans") > 0) | (F.size("entropy_spans") > 0)
    changed = evaluate_once(found, {"text": F.when(some, whole).otherwise(F.col("text")), "__some": some})
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn(
            "n_chars", F.when(F.col("__some"), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        )
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])
