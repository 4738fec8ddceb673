"""Language ID: averaged hashed subword embeddings, a linear softmax trained by SGD in numpy, calibrated rejection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.llm.common import bucket_of_id, slices, table
from bookweave.operators.topk import newest_per_key

BITS = 16
BUCKETS = 1 << BITS
#: Labelled rows that the model is fitted on, about: of each language, an equal number with the smallest hash of the id.
SAMPLE_ROWS = 3000
#: Subwords that count as known ones in every text, so that a few new ones do not make a short text unfamiliar.
GIVEN = 60
#: One row per language is broadcast up to so many languages.
SMALL_LANGUAGES = 100_000
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # [2 * BUCKETS, languages]: embedding times softmax weights, for each subword
    bias: np.ndarray
    temperature: float
    threshold: float
    known: np.ndarray  # [2 * BUCKETS]: 1 for subwords of the training texts
    familiar: float


def subwords(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Byte pairs and hashed runs of four bytes at every place of the joined texts, and where each text
    starts and ends in them. Letters A-Z count as lower case."""
    lower = pc.ascii_lower(texts)
    ends = np.cumsum(pc.binary_length(lower).to_numpy(zero_copy_only=False))
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    data = np.frombuffer(b"".join(lower.cast(pa.large_binary()).to_pylist()) + b"\0\0\0", np.uint8).astype(np.uint32)
    pairs = data[:-3] | (data[1:-2] << 8)
    runs = pairs | (data[2:-1] << 16) | (data[3:] << 24)
    runs = (runs * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return [pairs, runs], starts, ends


def per_text(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end] for each text; empty ranges give 0."""
    full = ends > starts
    out = np.zeros(len(starts))
    if full.any():
        bounds = np.stack([starts[full], ends[full]], 1).ravel()
        out[full] = np.add.reduceat(np.append(values, np.float32(0)), bounds)[::2]
    return out


def logits(texts: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the languages, and the share of subwords that the training texts have too."""
    grams, starts, ends = subwords(texts)
    total = np.zeros((len(texts), len(model.languages)))
    count, known = np.zeros(len(texts)), np.zeros(len(texts))
    for order, ids in zip((2, 4), grams):
        stop = np.maximum(ends - order + 1, starts)
        count += stop - starts
        known += per_text(model.known[(order == 4) * BUCKETS :][:BUCKETS][ids], starts, stop)
        for k in range(len(model.languages)):
            weights = np.ascontiguousarray(model.table[(order == 4) * BUCKETS :][:BUCKETS, k], np.float32)
            total[:, k] += per_text(weights[ids], starts, stop)
    return total / np.maximum(count, 1)[:, None] + model.bias, (known + GIVEN) / (count + GIVEN)


def judged(texts: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the language, its probability, whether the text is rejected) of each text with a letter."""
    raw, familiar = logits(texts, model)
    sure = softmax(raw / model.temperature)
    return sure.argmax(1), sure.max(1), (sure.max(1) < model.threshold) | (familiar < model.familiar)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def features(batches):
    """Distinct subwords and their shares, of whole texts (whole) and of one snippet of 48 bytes in each."""
    for batch in batches:
        ids, langs = batch.column("doc_id"), batch.column("lang")
        for start, texts in slices(batch.column("text")):
            raw = texts.to_pylist()
            snippets = []
            for k, t in enumerate(raw):
                at = (len(t) * ((start + k) * 7919 % 97)) // 97
                snippets.append(t[at : at + 48])
            for whole, part in ((True, texts), (False, pa.array(snippets, pa.large_string()))):
                (pairs, runs), begins, ends = subwords(part)
                rows = []
                for a, b in zip(begins, ends):
                    seen, n = np.unique(np.concatenate([pairs[a : max(a, b - 1)], runs[a : max(a, b - 3)] + BUCKETS]), return_counts=True)
                    rows.append((seen.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(part)),
                        langs.slice(start, len(part)),
                        pa.array([whole] * len(part)),
                        pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                        pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                    ],
                    names=["doc_id", "lang", "whole", "ids", "shares"],
                )


def train(examples: pa.Table, size: int = 16, seen: int = 48_000, rate: float = 20.0, max_false_rejection: float = 0.0005) -> LanguageModel | None:
    """Minibatch SGD on embeddings and softmax, until ``seen`` examples were seen, in 8 to 40 rounds. A fifth of the
    whole texts is set aside to fit the temperature and the confidence under which a text is rejected, so that at
    most that share of them is, and none that is clearly more probable than a guess. The share of known subwords under which a text counts as in no learned language
    is set as well: each language in turn is left out, and the limit lies midway between its texts, seen with the
    others' subwords, and the set-aside texts, but well below the latter's least ones (their distance from 1 again)."""
    if not len(examples):
        return None
    langs, doc_ids, whole = (examples.column(c).to_pylist() for c in ("lang", "doc_id", "whole"))
    languages = sorted(set(langs))
    code = {x: k for k, x in enumerate(languages)}
    rng = np.random.default_rng(7)
    order = sorted(range(len(examples)), key=lambda k: (doc_ids[k], whole[k]))
    aside = [k for n, k in enumerate(order) if whole[k] and not n // 2 % 5]
    own = {doc_ids[k] for k in aside}
    kept = [k for k in order if doc_ids[k] not in own] or order
    lists = examples.column("ids").combine_chunks()
    cuts = lists.offsets.to_numpy()
    all_ids, all_shares = lists.values.to_numpy(), examples.column("shares").combine_chunks().values.to_numpy()
    rows = [(all_ids[a:b], all_shares[a:b], code[x]) for a, b, x in zip(cuts, cuts[1:], langs)]
    embed = rng.normal(0, 0.1, (2 * BUCKETS, size)).astype(np.float32)
    weights = rng.normal(0, 0.1, (size, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def gathered(batch):
        ids = np.concatenate([rows[k][0] for k in batch])
        shares = np.concatenate([rows[k][1] for k in batch])
        owner = np.repeat(np.arange(len(batch)), [len(rows[k][0]) for k in batch])
        return ids, shares, owner

    def averaged(ids, shares, owner, n):
        x = np.zeros((n, size), np.float32)
        for d in range(size):
            x[:, d] = np.bincount(owner, embed[ids, d] * shares, minlength=n)
        return x

    epochs = max(8, min(40, seen // len(kept)))
    steps, total = 0, epochs * max(1, len(kept) // 64)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(kept), max(1, len(kept) // 64)):
            ids, shares, owner = gathered(batch)
            x = averaged(ids, shares, owner, len(batch))
            off = softmax(x @ weights + bias)
            off[np.arange(len(batch)), [rows[k][2] for k in batch]] -= 1
            off = (off / len(batch)).astype(np.float32)
            step = rate * (1 - steps / total)
            steps += 1
            back = off @ weights.T
            used, place = np.unique(ids, return_inverse=True)
            for d in range(size):
                embed[used, d] -= step * np.bincount(place, back[owner, d] * shares).astype(np.float32)
            weights -= 0.05 * step * (x.T @ off)
            bias -= 0.01 * step * off.sum(0)
    table = embed @ weights
    held = aside or order
    ids, shares, owner = gathered(held)
    raw = averaged(ids, shares, owner, len(held)) @ weights + bias
    truth = np.array([rows[k][2] for k in held])
    grid = np.geomspace(0.05, 20, 40)
    loss = [-np.log(softmax(raw / t)[np.arange(len(held)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = softmax(raw / temperature)
    right = sure.max(1)[sure.argmax(1) == truth]
    threshold = float(np.quantile(right, max_false_rejection)) if len(right) else 0.0
    per_language = np.zeros((len(languages), 2 * BUCKETS), bool)
    for k in kept:
        per_language[rows[k][2], rows[k][0]] = True
    times = {k: len(rows[k][0]) / max(1e-9, float(rows[k][1].sum())) for k in held}

    def familiarity(k: int, known: np.ndarray) -> float:
        return float((rows[k][1][known[rows[k][0]]].sum() * times[k] + GIVEN) / (times[k] + GIVEN))

    known = per_language.any(0)
    own_share = np.quantile([familiarity(k, known) for k in held], max_false_rejection)
    others = [np.delete(per_language, k, 0).any(0) for k in range(len(languages))]
    strange = [familiarity(k, others[rows[k][2]]) for k in held] if len(languages) > 1 else [0.0]
    familiar = min(own_share - (1 - own_share), (own_share + np.quantile(strange, 0.9)) / 2)
    return LanguageModel(languages, table, bias, temperature, min(threshold, 1.2 / len(languages)), known.astype(np.float32), float(familiar))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel | None:
    """Fit on about ``sample_rows`` rows that have a language, an id and a text and whose crc32(id) mod 5 is not 0: of
    each language an equal number, those with the smallest hash of the id (at least 20 of each, so very many
    languages make the sample larger). Only distinct subwords of these rows reach the driver."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of_id(F.col("doc_id"), 5) != 0))
    labelled = labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id").alias("_order"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    languages = counts.count()
    if not languages:
        return None
    each = max(20, sample_rows // languages)
    # hashes are even, so a share of their range holds about four times as many rows as wanted of each language,
    # whatever the number of tasks; of these the smallest are taken, and then the texts of just these
    near = F.col("_order") / F.lit(2.0**64) + 0.5 <= 4.0 * each / F.col("_n")
    sent = F.broadcast if languages <= SMALL_LANGUAGES else lambda rows: rows
    ids = labelled.select("lang", "_order").join(sent(counts), "lang").where(near)
    last = newest_per_key(ids, ["lang"], [F.col("_order")], each).groupBy("lang").agg(F.max("_order").alias("_last"))
    chosen = labelled.join(sent(last), "lang").where(F.col("_order") <= F.col("_last"))
    chosen = newest_per_key(chosen, ["lang"], [F.col("_order"), F.col("text")], each).select("doc_id", "lang", "text")
    got = chosen.mapInArrow(features, "doc_id bigint, lang string, whole boolean, ids array<int>, shares array<float>")
    return train(got.toArrow())


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected, one row per row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0 and is rejected; so is every text if there
    was nothing to learn from. Else the score is the calibrated probability of the language, and the text
    is rejected if that is under the model's threshold or too few of its subwords are known. Whole texts are read, of any length; repeated rows
    give repeated results, an empty table an empty one; other columns are not read."""

    def predict(batches):
        for batch in batches:
            out = []
            for _, texts in slices(batch.column("text"), 2 << 20):
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                if model is None:
                    out += [(UNKNOWN, 0.0, True)] * len(texts)
                    continue
                out += [(model.languages[k], float(p), bool(no)) if ok else (UNKNOWN, 0.0, True) for k, p, no, ok in zip(*judged(texts, model), letters)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(bucket_of_id(F.col("doc_id"), 5) == 0, F.lit(True))
    return identify(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is identified, with all their columns. The text is judged in the same pass
    that hands the row on, so nothing is joined."""
    model = fit(docs)
    schema = docs.schema

    def keep(batches):
        for batch in batches:
            mask = []
            for _, texts in slices(batch.column("text"), 2 << 20):
                letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                if model is None:
                    mask.append(np.zeros(len(texts), bool))
                else:
                    mask.append(letters & ~judged(texts, model)[2])
            if mask:
                yield batch.filter(pa.array(np.concatenate(mask)))

    return docs.mapInArrow(keep, schema)
