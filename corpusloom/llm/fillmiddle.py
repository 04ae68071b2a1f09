r"""Fill-in-the-middle rearrangement of whole texts, cut by ranks over character classes.

A unit is a run of ASCII letters or any other single character. Every byte of a batch of
texts gets one of four classes: first letter of a run, later letter, other character, and
later byte of a character. A wavelet matrix holds the classes. The units before a place are
the ranks of two classes, the characters before it all places less the rank of one. Both
cuts of all texts of the batch are found together by bisection on these counts; no token
list is ever made. Only the text goes to Python and only three numbers for each row come back;
moving the parts, and putting them back, are column expressions.

A text of n units is cut after ``h1 % (n + 1)`` and ``h2 % (n + 1)`` units, in order. The
numbers h1 to h4 are the first groups of eight digits of the SHA-256 of ``<seed>:<doc_id>``.
It stays ``plain`` if it's empty, holds one of the marks, or ``h3 % 100`` is in the plain
share; otherwise it becomes ``spm`` or ``psm``:

    psm   <P>prefix<S>suffix<M>middle        spm   <S>suffix<P>prefix<M>middle

Edge cases: a null text is empty (0 units, plain); a null id hashes as the empty string, so
all null ids get the same four numbers; rows are judged one by one, so repeated rows and ids
give equal results; parts may be empty; a cut never splits a character; an empty table gives
an empty result. Further columns are kept only if named in ``keep``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table
from corpusloom.llm.textgrams import slices, text_bytes
from corpusloom.llm.wavelet import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT, SEED = 10, 20, 1
#: Bytes of text whose classes a task holds at once; a longer text is alone.
CHUNK = 1 << 21

_FIRST, _LATER, _OTHER, _INSIDE = range(4)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def char_classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class of each byte; a run of letters ends with its text."""
    letter = _LETTER[data]
    later = np.zeros(len(data), bool)
    later[1:] = letter[1:] & letter[:-1]
    later[offsets[:-1][np.diff(offsets) > 0]] = False
    out = np.full(len(data), _OTHER, np.uint8)
    out[(data & 0xC0) == 0x80] = _INSIDE
    out[letter] = _FIRST
    out[later] = _LATER
    return out


def unit_cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray,
              h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the characters before its two cuts (as two rows)."""
    matrix = WaveletMatrix(char_classes(data, offsets), 2)

    def units(place: np.ndarray) -> np.ndarray:
        return matrix.rank(_FIRST, place) + matrix.rank(_OTHER, place)

    def chars(place: np.ndarray) -> np.ndarray:
        return place - matrix.rank(_INSIDE, place)

    begin, end = offsets[:-1], offsets[1:]
    base = units(begin)
    n = units(end) - base
    drawn = np.stack([h1 % (n + 1), h2 % (n + 1)])
    wanted = base + np.sort(drawn, axis=0)
    # The last place with no more than the wanted units before it starts the next unit.
    low, high = np.stack([begin, begin]), np.stack([end, end])
    while (low < high).any():
        middle = (low + high + 1) >> 1
        fits = units(middle) <= wanted
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return n, chars(low) - chars(begin)


def _cutter(chunk: int):
    kind = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        data, offsets = text_bytes(text)
        first, second = h1.to_numpy(), h2.to_numpy()
        n, at = np.empty(len(text), np.int64), np.empty((2, len(text)), np.int64)
        for lo, hi in slices(offsets, chunk):
            cut = offsets[lo:hi + 1]
            n[lo:hi], at[:, lo:hi] = unit_cuts(
                data[cut[0]:cut[-1]], cut - cut[0], first[lo:hi], second[lo:hi])
        return pa.StructArray.from_arrays([pa.array(n), pa.array(at[0]), pa.array(at[1])],
                                          fields=list(kind))

    return F.arrow_udf(cuts, "n long, a long, b long")


def _drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, keep: Sequence[str] = ("doc_id",), doc_id: str = "doc_id",
                   text: str = "text", seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``keep``, n_units, form, prefix_chars, middle_chars and output (the rearranged text).

    One row for each row of ``docs``. ``restored`` turns output and form into the text.
    """
    ids = [f"_k{i}" for i in range(len(keep))]
    raw = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = _drawn(F.col(doc_id), seed)
    marked = raw.contains(PREFIX) | raw.contains(SUFFIX) | raw.contains(MIDDLE)
    form = F.when((raw == "") | marked | (h3 % 100 >= 100 - plain_percent), "plain").when(
        h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, ids, strict=True)], raw.alias("_x"),
                       form.alias("_form"), h1.alias("_h1"), h2.alias("_h2"))
    cut = rows.select(*ids, "_x", "_form", _cutter(chunk)("_x", "_h1", "_h2").alias("_c"))
    a, b, x = F.col("_c.a").cast("int"), F.col("_c.b").cast("int"), F.col("_x")
    prefix, middle = F.substring(x, F.lit(1), a), F.substring(x, a + 1, b - a)
    suffix = F.substring(x, b + 1, F.length(x))
    plain = F.col("_form") == "plain"
    output = F.when(plain, x).when(
        F.col("_form") == "psm",
        F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(
        F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    return cut.select(
        *[F.col(i).alias(c) for c, i in zip(keep, ids, strict=True)],
        F.col("_c.n").alias("n_units"), F.col("_form").alias("form"),
        F.when(~plain, F.col("_c.a")).alias("prefix_chars"),
        F.when(~plain, F.col("_c.b") - F.col("_c.a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` rearranged, from its output and form alone.

    No part holds a mark, and no mark can arise where a part meets one: a mark's first and
    last characters differ from each other and from its middle one.
    """
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(rest))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(
        F.concat(prefix, middle, suffix))


_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix,
    coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", _SQL)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))
