"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one bit per
failed rule; a *policy* is a version name with a mask of rules, applied to the bits alone.  Rules
can so be added to a policy, dropped from it or ablated without reading a text again.

Defined cases: a null text or one without words has no words and fails ``too_few_words``; very
long texts are measured whole (memory: one document's words); repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")

#: Rule -> condition of failure over the measurements (SQL, the same text in Spark and the oracle).
#: The position in this table is the rule's bit; append only, so that stored ledgers stay readable.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "short_words": "2 * word_chars < 5 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "shouting": "100 * n_upper_words > 40 * n_words",
}

#: Policy version -> rules it enforces.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}

_WHITE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules) -> int:
    return sum(bit(r) for r in rules)


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more, the first find included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def measure_text(text: bytes) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of MEASURES.  ``bytes.split`` and ``strip``
    know exactly the six white-space characters that end a word here."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, _WHITE + _CONTINUATION)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeated(words),
        sum(map(bytes.isupper, words)),
    )


_MEASURED = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


@F.arrow_udf(_MEASURED)
def _measured(texts: pa.Array) -> pa.Array:
    rows = [measure_text(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
    columns = list(zip(*rows)) or [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))


def failure_bits() -> Column:
    return sum((F.when(F.expr(cond), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, cond in RULES.items()), F.lit(0)).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs + MEASURES + ``failures`` (long; bit i: rule i failed).  No shuffle."""
    drop = [c for c in docs.columns if c.lower() in {*MEASURES, "failures"} and c != text]
    out = docs.drop(*drop).withColumn("__m", _measured(whole_text(text).cast("binary")))
    out = out.select("*", *[F.col(f"__m.{m}").alias(m) for m in MEASURES]).drop("__m")
    return out.withColumn("failures", failure_bits())


def passes(policy: str = "v1") -> Column:
    """Whether a ledger's row passes a policy: none of the policy's bits is set."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """(policy, rule, n_docs, n_failed, n_kept, n_kept_without): what dropping one rule would win.
    One aggregation over the bits: the rows are first counted by bit pattern (2^rules groups at
    most, combined before the shuffle)."""
    whole = mask(POLICIES[policy])
    patterns = led.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("__bits")).agg(F.count("*").alias("__n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("b")) for r in POLICIES[policy]]))
    b = F.col("__r.b")
    bits = F.col("__bits")
    return (
        patterns.withColumn("__r", rules)
        .groupBy(F.lit(policy).alias("policy"), F.col("__r.rule").alias("rule"))
        .agg(
            F.sum("__n").alias("n_docs"),
            F.sum(F.when(bits.bitwiseAND(b) != 0, F.col("__n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(bits == 0, F.col("__n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when(bits.bitwiseAND(F.lit(whole) - b) == 0, F.col("__n")).otherwise(0)).alias("n_kept_without"),
        )
    )
