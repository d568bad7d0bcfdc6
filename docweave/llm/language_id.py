"""Language ID with interpolated Kneser-Ney character models in sorted hash arrays.

A model reads words between a start and an end mark. Its counts are gathered by Spark
from a bounded sample of labelled rows per language; the discounted, interpolated
probabilities of all languages share one sorted array of n-gram hashes per order,
with a column per language, so one binary search serves every language. A text goes to
the language with the lowest cross-entropy per character. Whether that is low enough
to be text of the language at all is calibrated on labelled rows that the counts have
not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.blocks import mix, stored, text_blocks, word_bounds, word_hashes

ORDER = 5
#: Labelled rows per language that counting and calibration may use, chosen by a hash of the doc_id.
SAMPLE_ROWS = 3000
CALIBRATION_SHARE = 8  # one sampled row in so many calibrates instead of counting
#: Rejected: beyond this many times the calibrated quantile, and by at least so many bits per character.
REJECT_QUANTILE, REJECT_FACTOR, REJECT_BITS = 0.995, 2.0, 2.0
CACHE_WORDS = 1 << 21
UNDETERMINED = "und"

_START, _END = 2, 3
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_GRAMS = "lang string, k int, gram long, ctx long, suffix long, head boolean, n long"


def _marked(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words with their marks, and where each word begins."""
    text = "".join(f"{chr(_START)}{w}{chr(_END)}" for w in words)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)])
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64), starts


def _grams(points: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length k: hash of the k code points that end at each place, and whether they lie in its word."""
    values = mix(points + np.uint64(1))
    depth = np.arange(len(points)) - np.repeat(starts[:-1], np.diff(starts))
    out, sums, factor = [], np.zeros(len(points), np.uint64), np.ones(1, np.uint64)
    for k in range(1, order + 1):
        sums[k - 1 :] += values[: len(values) - k + 1] * factor
        factor = factor * _STEP
        out.append((mix(sums + np.uint64(k)), depth >= k - 1))
    return out


def _block_words(column: pa.Array) -> Iterator[tuple]:
    """Blocks ``(first row, end row, bytes, starts, ends, hashes, first word per row)``."""
    for lo, hi, buf, offsets in text_blocks(column, 1 << 21):
        starts, ends, bounds = word_bounds(buf, offsets, _LETTER)
        yield lo, hi, buf, starts, ends, word_hashes(buf, starts, ends), bounds


def _strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    data = buf.tobytes()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist())]


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang")
        for lo, hi, buf, starts, ends, hashes, bounds in _block_words(batch.column("text")):
            owner = np.repeat(np.arange(lo, hi), np.diff(bounds))
            names = langs.slice(lo, hi - lo).to_pylist()
            for lang in sorted(set(names)):
                mine = np.isin(owner, lo + np.flatnonzero([x == lang for x in names]))
                at = np.flatnonzero(mine)
                _, first, counts = np.unique(hashes[at], return_index=True, return_counts=True)
                points, begin = _marked(_strings(buf, starts[at[first]], ends[at[first]]))
                weight = np.repeat(counts, np.diff(begin))
                grams = _grams(points, begin, order)
                for k in range(1, order + 1):
                    gram, inside = grams[k - 1]
                    ok = np.flatnonzero(inside & (points != _START))
                    keys, where, inverse = np.unique(gram[ok], return_index=True, return_inverse=True)
                    n = np.bincount(inverse, weights=weight[ok], minlength=len(keys)).astype(np.int64)
                    place = ok[where]
                    none = np.zeros(len(keys), np.uint64)
                    ctx = grams[k - 2][0][place - 1] if k > 1 else none
                    suffix = grams[k - 2][0][place] if k > 1 else none
                    head = points[place - k + 1] == _START
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(keys), pa.string()),
                            pa.array(np.full(len(keys), k, np.int32)),
                            *(pa.array(v.view(np.int64)) for v in (keys, ctx, suffix)),
                            pa.array(head),
                            pa.array(n),
                        ],
                        names=["lang", "k", "gram", "ctx", "suffix", "head", "n"],
                    )


class LanguageModels(NamedTuple):
    """Per order: sorted gram hashes with probabilities per language, sorted context hashes with back-off weights."""

    langs: list[str]
    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    unknown: np.ndarray

    @staticmethod
    def build(counts: pd.DataFrame, order: int) -> LanguageModels:
        """Interpolated Kneser-Ney from counts of all lengths up to ``order``.

        Below the highest order a gram counts the different characters before it, or
        its occurrences if it begins at the start mark. Every order has one discount
        per language, from its grams seen once and twice.
        """
        for c in ("gram", "ctx", "suffix"):
            counts[c] = counts[c].to_numpy().view(np.uint64)
        langs = sorted(counts["lang"].unique())
        number = {lang: i for i, lang in enumerate(langs)}
        counts["l"] = counts["lang"].map(number).astype(np.int64)
        grams, probs, contexts, weights = [], [], [], []
        unknown = np.ones(len(langs))
        by_order = {k: part for k, part in counts.groupby("k")}
        for k in range(1, order + 1):
            own = by_order[k]
            value = own["n"].to_numpy(np.float64)
            if k < order:
                before = by_order[k + 1].groupby(["l", "suffix"]).size().rename("before").reset_index()
                seen = own.merge(before, left_on=["l", "gram"], right_on=["l", "suffix"], how="left")["before"].to_numpy()
                value = np.where(own["head"].to_numpy(), value, np.nan_to_num(seen, nan=1.0))
            own = own.assign(value=value)
            once = own[own["value"] == 1].groupby("l").size().reindex(range(len(langs)), fill_value=0).to_numpy()
            twice = own[own["value"] == 2].groupby("l").size().reindex(range(len(langs)), fill_value=0).to_numpy()
            discount = np.clip((once + 0.5) / (once + 2 * twice + 1.0), 0.05, 0.95)
            total = own.groupby(["l", "ctx"])["value"].agg(["sum", "size"]).reset_index()
            keys, at = np.unique(total["ctx"].to_numpy(), return_inverse=True)
            weight = np.ones((len(keys), len(langs)))
            weight[at, total["l"]] = discount[total["l"]] * total["size"] / total["sum"]
            sums = np.ones((len(keys), len(langs)))
            sums[at, total["l"]] = total["sum"]
            names, first, inverse = np.unique(own["gram"].to_numpy(), return_index=True, return_inverse=True)
            ctx = np.searchsorted(keys, own["ctx"].to_numpy()[first])
            if k == 1:
                unknown = weight[0] / (len(names) + 1)
                below = np.broadcast_to(1.0 / (len(names) + 1), (len(names), len(langs)))
            else:
                below = probs[-1][np.searchsorted(grams[-1], own["suffix"].to_numpy()[first])]
            prob = weight[ctx] * below
            l = own["l"].to_numpy()
            prob[inverse, l] += np.maximum(own["value"].to_numpy() - discount[l], 0) / sums[ctx[inverse], l]
            grams.append(names)
            probs.append(prob)
            contexts.append(keys)
            weights.append(weight)
        return LanguageModels(langs, grams, probs, contexts, weights, unknown)

    def cost(self, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each word under each language, and in the last column its predicted characters."""
        order = len(self.grams)
        grams = _grams(points, starts, order)
        predicted = np.flatnonzero(points != _START)
        prob = np.tile(self.unknown, (len(predicted), 1))
        scale = np.ones((len(predicted), len(self.langs)))
        open_ = np.ones(len(predicted), bool)
        for k in range(order, 0, -1):
            rows = np.flatnonzero(open_ & grams[k - 1][1][predicted])
            if not len(rows):
                continue
            place = predicted[rows]
            hit, at = _find(self.grams[k - 1], grams[k - 1][0][place])
            prob[rows[hit]] = self.probs[k - 1][at[hit]]
            open_[rows[hit]] = False
            if k > 1:
                miss, place = rows[~hit], place[~hit]
                known, at = _find(self.contexts[k - 1], grams[k - 2][0][place - 1])
                scale[miss[known]] *= self.weights[k - 1][at[known]]
        bits = -np.log2(prob * scale)
        cuts = np.searchsorted(predicted, starts[:-1])
        sums = np.add.reduceat(bits, cuts, axis=0)
        return np.column_stack([sums, np.diff(np.append(cuts, len(predicted)))])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


class _WordCosts:
    """Costs per distinct word, kept in arrays sorted by hash; a full cache is emptied."""

    def __init__(self, models: LanguageModels) -> None:
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.costs = np.zeros((0, len(self.models.langs) + 1), np.float32)

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if len(self.keys) + int(new.sum()) > CACHE_WORDS:
            self.clear()
            new[:] = True
        if new.any():
            words = _strings(buf, starts[first[new]], ends[first[new]])
            found = self.models.cost(*_marked(words)).astype(np.float32)
            at = np.searchsorted(self.keys, keys[new])
            self.keys, self.costs = np.insert(self.keys, at, keys[new]), np.insert(self.costs, at, found, axis=0)
        return self.costs[np.searchsorted(self.keys, keys)][inverse]


def _scored(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    models: LanguageModels = shared.value
    costs = _WordCosts(models)
    names = np.array(models.langs, object)
    for batch in batches:
        for lo, hi, buf, starts, ends, hashes, bounds in _block_words(batch.column("text")):
            n = hi - lo
            if len(starts):
                sums = np.zeros((len(starts) + 1, len(names) + 1))
                np.cumsum(costs.of(buf, starts, ends, hashes), axis=0, out=sums[1:])
                total = np.diff(sums[bounds], axis=0)
            else:
                total = np.zeros((n, len(names) + 1))
            size = total[:, -1]
            rate = total[:, :-1] / np.maximum(size, 1)[:, None]
            best = np.argmin(rate, axis=1)
            low = rate[np.arange(n), best]
            gap = (rate - low[:, None]) * np.log(2) * np.minimum(size, 50)[:, None]
            posterior = 1 / np.exp(-gap).sum(axis=1)
            rest = [batch.column(c).slice(lo, n) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(names[best], pa.string()), pa.array(posterior), pa.array(low), pa.array(size.astype(np.int64))],
                names=[*(c for c in batch.schema.names if c != "text"), "best", "posterior", "cross_entropy", "n_chars_scored"],
            )


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class LanguageIdentifier(NamedTuple):
    """Models and, per language, the limit of ``(cross-entropy - mean) * sqrt(characters)``."""

    models: LanguageModels | None
    limits: dict[str, tuple[float, float]]

    @staticmethod
    def train(
        labelled: DataFrame, order: int = ORDER, sample_rows: int = SAMPLE_ROWS, share: int = CALIBRATION_SHARE
    ) -> LanguageIdentifier:
        """Fit on ``labelled(doc_id, text, lang)``; rows with a null in any of them are left out.

        About ``sample_rows`` rows per language are read, whole, with the chance that
        this number gives each row of the language; smaller languages are read in full.
        """
        spark = labelled.sparkSession
        rows = labelled.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"), F.col("lang").cast("string").alias("lang")
        ).where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
        per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
        if not per_lang:
            return LanguageIdentifier(None, {})
        draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        chance = F.lit(0.0)
        for lang, n in per_lang.items():
            chance = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_rows / n))).otherwise(chance)
        held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(share)) == 0
        sample = stored(rows.where(draw < chance).withColumn("_held", held), "labelled")
        spread = sample.repartition(max(8, spark.sparkContext.defaultParallelism))
        grams = spread.where("NOT _held").select("text", "lang").mapInArrow(lambda it: _count(it, order), _GRAMS)
        grams = grams.groupBy("lang", "k", "gram").agg(
            F.first("ctx").alias("ctx"), F.first("suffix").alias("suffix"), F.first("head").alias("head"), F.sum("n").alias("n")
        )
        counts = grams.toArrow().to_pandas()  # bounded by sample_rows
        if counts.empty:
            return LanguageIdentifier(None, {})
        model = LanguageIdentifier(LanguageModels.build(counts, order), {})
        scored = stored(model.score(spread.where("_held"), "lang"), "calibration").where("best = lang AND n_chars_scored > 0")
        means = {r[0]: r[1] for r in scored.groupBy("lang").agg(F.avg("cross_entropy")).collect()}
        z = F.lit(None).cast("double")
        for lang, mean in means.items():
            z = F.when(F.col("lang") == lang, (F.col("cross_entropy") - mean) * F.sqrt("n_chars_scored")).otherwise(z)
        tails = scored.groupBy("lang").agg(F.percentile_approx(z, REJECT_QUANTILE, 10_000)).collect()
        return model._replace(limits={r[0]: (means[r[0]], max(1.0, r[1]) * REJECT_FACTOR) for r in tails})

    def score(self, docs: DataFrame, *carry: str) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(self.models)
        rows = docs.select(*carry, "text")
        schema = rows.drop("text").schema
        for name, kind in (("best", "string"), ("posterior", "double"), ("cross_entropy", "double"), ("n_chars_scored", "long")):
            schema = schema.add(name, kind)
        return rows.mapInArrow(lambda it: _scored(it, shared), schema)

    def predict(self, docs: DataFrame, *carry: str) -> DataFrame:
        """``carry`` columns with lang_pred, score (0 to 1), rejected, cross_entropy and n_chars_scored.

        A text that is null or has no letter is ``und`` with score 0, and rejected; so
        is everything when nothing was learned. The score is the best language's
        share of the likelihood over at most 50 characters.
        """
        letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        rows = docs.select(*carry, letters.alias("_letters"), F.lower("text").alias("text"))
        if self.models is None:
            return rows.select(
                *carry,
                F.lit(UNDETERMINED).alias("lang_pred"),
                F.lit(0.0).alias("score"),
                F.lit(True).alias("rejected"),
                F.lit(0.0).alias("cross_entropy"),
                F.lit(0).cast("long").alias("n_chars_scored"),
            )
        scored = self.score(rows, *carry, "_letters")
        far = F.lit(False)
        for lang, (mean, limit) in self.limits.items():
            excess = F.col("cross_entropy") - F.lit(mean)
            beyond = (excess * F.sqrt("n_chars_scored") > F.lit(limit)) & (excess > REJECT_BITS)
            far = F.when(F.col("best") == lang, beyond).otherwise(far)
        known = F.col("_letters") & (F.col("n_chars_scored") > 0)
        return scored.select(
            *carry,
            F.when(known, F.col("best")).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
            F.when(known, F.col("posterior")).otherwise(F.lit(0.0)).alias("score"),
            (~known | far).alias("rejected"),
            "cross_entropy",
            "n_chars_scored",
        )


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected, cross_entropy, n_chars_scored`` per row of ``docs``.

    Learns from the text and lang of rows that are not held out. Repeated rows are
    scored each; a null doc_id is neither held out nor learned from; other columns are
    ignored. Predictions read the text alone.
    """
    held = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held_out(F.col("doc_id")).alias("held_out")
    )
    model = LanguageIdentifier.train(held.where("NOT held_out"))
    return model.predict(held, "doc_id", "held_out")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not rejected, with all their columns, ``text`` unchanged."""
    model = LanguageIdentifier.train(docs.where(~held_out(F.col("doc_id"))))
    names = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    kept = docs.withColumn("_row", F.struct(*names))
    return model.predict(kept, "_row").where("NOT rejected").select("_row.*")
