"""Language of documents by mixtures of byte-trigram models.

Counts of hashed byte trigrams, over all documents that may be learned from, give one
distribution for each language. A document is a mixture of languages: expectation
maximisation estimates its proportions. Sets of the one, two, ... likeliest languages are
fitted in turn, up to all that were learned, and the set with the best log-likelihood less
a penalty for each language is selected; its largest share names the language, and that
share is the score. A text leaves the search when no larger set can win: an upper bound of
the likelihood of any mixture, less the penalty of one language more, is under its best.

Counting sums arrays inside each task, so it shuffles at most one row for each language,
trigram bucket and task. The model has ``buckets`` numbers for each language and is
broadcast; the number of languages is checked (``MAX_LANGUAGES``). Prediction is one map.

Edge cases: a null text and one without a letter is ``und`` with score 0; texts shorter
than three bytes are padded; equal shares go to the language first in the alphabet;
without anything to learn from every prediction is ``und``; a null id is never learned from
and isn't held out; repeated rows are counted and predicted each; an empty table gives an
empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.registry import query, table
from corpusloom.llm.share import opened, shared
from corpusloom.llm.textgrams import U, mix, slices, text_bytes

BUCKETS = 1 << 16
MAX_LANGUAGES = 128
#: Log-likelihood that a further language must add, for each log of the number of trigrams.
PENALTY = 2.0
ROUNDS = 8
UNKNOWN = "und"
_SMOOTH = 0.05
_TEXT_CHUNK = 1 << 18


def held_out(doc_id: str = "doc_id") -> Column:
    """A quarter of the documents, by the checksum of their id; nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def trigrams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each byte trigram; digits count as one byte, texts are padded with spaces."""
    size = np.diff(offsets)
    data = np.where((data >= 48) & (data <= 57), np.uint8(48), data)
    # Two spaces before each text keep trigrams of neighbours apart.
    texts = len(size)
    wide = np.full(len(data) + 2 * texts + 2, 32, np.uint8)
    owner = np.repeat(np.arange(texts), size)
    wide[np.arange(len(data)) + 2 * (owner + 1)] = data
    code = (wide[:-2].astype(U) << U(16)) | (wide[1:-1].astype(U) << U(8)) | wide[2:].astype(U)
    text = np.repeat(np.arange(texts), size + 2)
    return text, (mix(code[:len(text)]) % U(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column("_l").to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column("_x"))
            for lo, hi in slices(offsets, _TEXT_CHUNK):
                cut = offsets[lo:hi + 1]
                text, gram = trigrams(data[cut[0]:cut[-1]], cut - cut[0], buckets)
                names, code = np.unique(lang[lo:hi].astype(str), return_inverse=True)
                seen = np.bincount(code[text] * buckets + gram, minlength=len(names) * buckets)
                for name, row in zip(names, seen.reshape(len(names), buckets), strict=True):
                    if name in sums:
                        sums[name] += row
                    else:
                        sums[name] = row
        for name, row in sums.items():
            gram = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(gram)), pa.array(gram), pa.array(row[gram])],
                names=["lang", "gram", "n"])
    return run


@dataclass
class Mixture:
    """Languages in alphabetical order and the probability of each bucket in each."""

    languages: list[str]
    chance: np.ndarray  # buckets x languages

    def fit(self, text: np.ndarray, gram: np.ndarray, texts: int):
        """Proportions (texts x languages) of the selected set of each text."""
        width = len(self.languages)
        key = np.sort(text * len(self.chance) + gram)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(key))).astype(np.float64)
        own, bucket = np.divmod(key[heads], len(self.chance))
        chance = self.chance[bucket]
        begin = np.searchsorted(own, np.arange(texts))  # every text has a trigram
        total = np.add.reduceat(count, begin)

        def part_of(share: np.ndarray, held: tuple) -> np.ndarray:
            """For each text and language: what the share is multiplied by in the next round."""
            own, chance, count, begin, total = held
            mixed = count / np.einsum("ij,ij->i", share[own], chance)
            return np.add.reduceat(chance * mixed[:, None], begin, axis=0) / total[:, None]

        def improve(share: np.ndarray, rounds: int, held: tuple) -> np.ndarray:
            own, chance, count, begin, total = held
            for _ in range(rounds):
                part = share[own] * chance
                part *= (count / part.sum(1))[:, None]
                share = np.add.reduceat(part, begin, axis=0) / total[:, None]
            return share

        def likelihood(share: np.ndarray, held: tuple) -> np.ndarray:
            own, chance, count, begin, _ = held
            return np.add.reduceat(count * np.log((share[own] * chance).sum(1)), begin)

        def narrowed(held: tuple, stay: np.ndarray) -> tuple:
            own, chance, count, _, total = held
            rows = stay[own]
            own = (np.cumsum(stay) - 1)[own[rows]]
            return own, chance[rows], count[rows], np.searchsorted(own, np.arange(stay.sum())), total[stay]

        held = (own, chance, count, begin, total)
        free = improve(np.full((texts, width), 1 / width), ROUNDS, held)
        order = np.argsort(-free, axis=1, kind="stable")
        # By Jensen's inequality no mixture of any set is likelier than this.
        bound = likelihood(free, held) + total * np.log(part_of(free, held).max(1))
        best, best_value = np.zeros_like(free), np.full(texts, -np.inf)
        left = np.arange(texts)
        for size in range(1, width + 1):
            share = np.zeros((len(left), width))
            chosen = order[left, :size]
            np.put_along_axis(share, chosen, np.maximum(np.take_along_axis(free[left], chosen, 1), 1e-6), 1)
            share /= share.sum(1, keepdims=True)
            if size > 1:
                share = improve(share, ROUNDS // 2, held)
            value = likelihood(share, held) - PENALTY * size * np.log(held[-1] + 1)
            better = value > best_value[left]
            best[left[better]], best_value[left[better]] = share[better], value[better]
            stay = bound[left] - PENALTY * (size + 1) * np.log(held[-1] + 1) > best_value[left]
            if not stay.any():
                break
            if not stay.all():
                left, held = left[stay], narrowed(held, stay)
        return best


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> Mixture:
    """The model of all rows of ``docs`` with a text and a language."""
    rows = docs.select(F.col(lang).alias("_l"), F.col(text).alias("_x")).where(
        "_l IS NOT NULL AND _x IS NOT NULL")
    counts = rows.mapInArrow(_count(buckets), "lang string, gram long, n long").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).limit(
        MAX_LANGUAGES + 1).toArrow()
    if found.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = found.column("lang").to_pylist()
    table_ = np.full((buckets, len(names)), _SMOOTH)
    at = np.argsort(names)
    for place, row in enumerate(at):
        grams = found.column("grams")[int(row)].values.flatten()
        table_[grams[0].to_numpy(), place] += grams[1].to_numpy()
    return Mixture([names[i] for i in at], table_ / table_.sum(0))


def _predict(model, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture: Mixture = opened(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            chunk = 4 * _TEXT_CHUNK // max(4, len(mixture.languages))
            for lo, hi in slices(offsets, chunk):
                cut = offsets[lo:hi + 1]
                texts = hi - lo
                if mixture.languages:
                    share = mixture.fit(*trigrams(data[cut[0]:cut[-1]], cut - cut[0],
                                                  len(mixture.chance)), texts)
                    top = share.argmax(1)
                    name = [mixture.languages[i] for i in top]
                    score = share[np.arange(texts), top].clip(0, 1)
                    mixed = [[{"lang": mixture.languages[i], "share": float(row[i])}
                              for i in np.flatnonzero(row > 0)] for row in share]
                else:
                    name, score, mixed = [UNKNOWN] * texts, np.zeros(texts), [[]] * texts
                letter = batch.column("_letter").slice(lo, texts).to_numpy(zero_copy_only=False)
                columns = [batch.column(c).slice(lo, texts) for c in keep]
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                columns += [pa.array([n if ok else UNKNOWN for n, ok in zip(name, letter, strict=True)]),
                            pa.array(np.where(letter, score, 0.0)),
                            pa.array([m if ok else [] for m, ok in zip(mixed, letter, strict=True)], kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "mixture"])
    return run


def identify(docs: DataFrame, model: Mixture, keep: Sequence[str] = ("doc_id",),
             text: str = "text") -> DataFrame:
    """``keep``, lang_pred, score and mixture (languages with their shares)."""
    ids = [f"_k{i}" for i in range(len(keep))]
    own = ids[list(keep).index(text)] if text in keep else "_x"
    more = [] if text in keep else [F.col(text).alias(own)]
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, ids, strict=True)], *more,
                       F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    schema = T.StructType([*[rows.schema[i] for i in ids], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("mixture", T.ArrayType(T.StructType([
                               T.StructField("lang", T.StringType()),
                               T.StructField("share", T.DoubleType())])))])
    held = shared(docs.sparkSession, model)
    return rows.mapInArrow(_predict(held, ids, own), schema).select(
        *[F.col(i).alias(c) for c, i in zip(keep, ids, strict=True)], "lang_pred", "score", "mixture")


def learned_from(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id))


@query("op4_mixture_langid")
def op4_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(learned_from(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
