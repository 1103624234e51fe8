"""Multilingual mixture inference over byte trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import Scratch, bounded_batches, free_names, released

BUCKETS = 1 << 15
MOST_LANGUAGES = 256
#: Trigrams overlap, so a document of n of them counts as n / OVERLAP independent ones.
OVERLAP = 3.0
#: Penalty of one more language, in nats times log of the independent count.
PENALTY = 1.0
SMOOTHING = 0.02
#: Held-out documents of a language that are enough to tell how well its texts fit; with fewer, those of all languages do,
#: and with fewer of all no text is taken for foreign.
LEAST_HELD = 20
#: Standard deviations of the fit below which a text is of no learned language, and the least deviation
#: between documents in nats a trigram.
MARGIN = 10.0
LEAST_SPREAD = 0.1
#: Slots in which a pass counts values while it looks for a median.
SLOTS = 256


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of each row's lower-cased letters, other characters counting as one
    space, and the rows' offsets in them."""
    n = len(off) - 1
    low = B.LOWER[data]
    upper2 = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) > 1 else []
    low[upper2] += 0x20
    letter = ((low >= 97) & (low <= 122)) | (low >= 0x80)
    # every row gets a blank before and after it
    at = off + 2 * np.arange(n + 1)
    spaced = np.full(at[-1], 0x20, np.uint8)
    row = np.repeat(np.arange(n), np.diff(off))
    spaced[np.arange(len(data)) + 2 * row + 1] = np.where(letter, low, 0x20)
    keep = np.ones(len(spaced), bool)
    keep[1:] = (spaced[1:] != 0x20) | (spaced[:-1] != 0x20)
    keep[at[:-1]] = True
    start = np.concatenate([[0], np.cumsum(keep)])[at]
    s = spaced[keep].astype(np.uint32)
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    code = (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]
    inside = np.zeros(len(s), bool)
    size = np.maximum(np.diff(start) - 2, 0)
    first = start[:-1]
    index = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    inside[index] = True
    code = code[inside[: len(code)]]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), np.concatenate([[0], np.cumsum(size)])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their log probabilities of each bucket, from the whole text of all rows with non-null
    ``lang``.

    Counting is distributed and the driver gets at most MOST_LANGUAGES * BUCKETS sums.
    """
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            label = np.array([langs.index(x) for x in batch["lang"].to_pylist()])
            for a, b in B.blocks(off):
                grams, at = _trigrams(data[off[a] : off[b]], off[a : b + 1] - off[a])
                which = np.repeat(label[a:b], np.diff(at))
                sums += np.bincount(which * BUCKETS + grams, minlength=sums.size).reshape(sums.shape)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[lang, bucket])], ["lang", "bucket", "n"])

    sums = np.zeros((BUCKETS, len(langs)))
    with bounded_batches(docs.sparkSession):
        found = docs.mapInArrow(released(count), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    sums[np.asarray(found["bucket"]), np.asarray(found["lang"])] = np.asarray(found["n"])
    prob = (sums + SMOOTHING) / (sums + SMOOTHING).sum(axis=0)
    return langs, np.log(prob).astype(np.float32)


def _mixture(prob: np.ndarray, weights: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the language proportions; the proportions and log likelihood."""
    for _ in range(rounds):
        new = (prob * weights / (prob @ weights)[:, None]).mean(axis=0)
        if np.abs(new - weights).max() < 1e-4:
            weights = new
            break
        weights = new
    return weights, float(np.log(prob @ weights).sum())


def single_languages(logs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document of a block (``at``: offsets in the trigrams' rows): its log likelihood in each
    language alone, the best one, its posterior among them, and whether concavity proves that no mixture
    gains more than the penalty of one more language."""
    size = np.diff(at)
    some = np.flatnonzero(size)
    single = np.zeros((len(size), logs.shape[1]))
    ratio = np.zeros(len(size))
    if len(some):
        first = at[:-1][some]
        single[some] = np.add.reduceat(logs, first, axis=0, dtype=np.float64) / OVERLAP
        best = single.argmax(axis=1)
        own = np.take_along_axis(logs, np.repeat(best, size)[:, None], axis=1)
        gain = np.exp(np.minimum(logs - own, 20.0))
        ratio[some] = (np.add.reduceat(gain, first, axis=0, dtype=np.float64) / size[some, None]).max(axis=1)
    best = single.argmax(axis=1)
    lead = np.take_along_axis(single, best[:, None], axis=1)
    posterior = 1 / np.exp(np.clip(single - lead, -60, 0)).sum(axis=1)
    cost = PENALTY * np.log(np.maximum(size / OVERLAP, 2.0))
    return single, best, posterior, (logs.shape[1] == 1) | ((size / OVERLAP) * (ratio - 1) <= cost)


def mixed_languages(log_prob: np.ndarray, single: np.ndarray, best: int) -> np.ndarray | None:
    """Proportions of the languages in one document (rows: its trigrams), None where one is best.

    A set of languages is worth its likelihood less a penalty for each language; sets grow in order
    of the full mixture's proportions, and of equal ones in the order of the languages.
    """
    n, k = log_prob.shape
    cost = PENALTY * np.log(max(n / OVERLAP, 2.0))
    prob = np.exp(log_prob - log_prob.max(axis=1, keepdims=True)).astype(np.float64)
    shift = log_prob.max(axis=1).sum() / OVERLAP
    full, _ = _mixture(prob, np.full(k, 1.0 / k))
    worth, chosen = single[best] - cost, None
    order = [best, *[j for j in np.argsort(-full, kind="stable") if j != best]]
    for size in range(2, k + 1):
        got, ll = _mixture(prob[:, order[:size]], np.full(size, 1.0 / size))
        if (now := ll / OVERLAP + shift - size * cost) <= worth:
            break
        worth, chosen = now, np.zeros(k)
        chosen[order[:size]] = got
    return chosen


def predict(docs: DataFrame, langs: list[str], log_prob: np.ndarray, keep: list[str] | None = None, fit: bool = False) -> DataFrame:
    """``keep`` columns with __lang_pred, __score and __lang_set of every whole text.

    __lang_pred is the language of the largest proportion, ``und`` where the text is null or has no
    letter or nothing was learned; __score is that proportion times the posterior among single
    languages, 0 for ``und``; __lang_set lists the chosen languages. With ``fit``, __fit and __sd are the
    mean and deviation of the trigrams' log likelihoods, each in the likeliest chosen language, and
    __trigrams is their number; all are 0 for ``und``.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(log_prob)
    keep = keep if keep is not None else ["doc_id"]
    fields = [f for f in docs.schema.fields if f.name in keep]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__lang_pred string", "__score double", "__lang_set array<string>"] + ["__fit double", "__sd double", "__trigrams long"] * fit)
    text = "text" if "text" in names else "__text"
    block = max(1 << 16, (1 << 20) // max(len(langs), 1))  # bytes whose likelihoods in all languages are held at once

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        for batch in batches:
            data, off = B.column_bytes(batch[text])
            for a, b in B.blocks(off, block):
                pred, score, sets, fits = [], [], [], []
                own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                grams, g = _trigrams(own, at)
                logs = table[grams]
                low = B.LOWER[own]
                ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])[at]
                single, best, posterior, alone = single_languages(logs, g) if langs else (None, None, None, None)
                for r in range(b - a):
                    has = ascii_letters[r + 1] > ascii_letters[r] or any(c.isalpha() for c in own[at[r] : at[r + 1]].tobytes().decode())
                    if not has or g[r] == g[r + 1] or not langs:
                        pred.append("und"), score.append(0.0), sets.append([]), fits.append((0.0, 0.0, 0))
                        continue
                    rows, top, chance, chosen = logs[g[r] : g[r + 1]], int(best[r]), float(posterior[r]), [int(best[r])]
                    if not alone[r] and (weights := mixed_languages(rows, single[r], top)) is not None:
                        top = int(weights.argmax())
                        chance, chosen = float(weights[top]), np.flatnonzero(weights).tolist()
                    pred.append(langs[top])
                    score.append(min(1.0, chance))
                    sets.append([langs[j] for j in chosen])
                    if fit:
                        most = rows[:, chosen].max(axis=1)
                        fits.append((float(most.mean(dtype=np.float64)), float(most.std(dtype=np.float64)), len(most)))
                arrays = [batch[n].slice(a, b - a) for n in names] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))]
                if fit:
                    arrays += [pa.array([x[j] for x in fits], kind) for j, kind in enumerate((pa.float64(), pa.float64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, "__lang_pred", "__score", "__lang_set", *["__fit", "__sd", "__trigrams"] * fit])

    columns = [F.col(f"`{n}`") for n in names]
    return docs.select(*columns, *([] if text == "text" else [F.col("text").alias("__text")])).mapInArrow(released(label), schema)


def is_held_out():
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Held-out evaluation form: train on the other four fifths, predict all.

    doc_id, held_out, lang_pred, score, lang_set. A null doc_id has no remainder and is not held out;
    repeated rows each have their prediction; of equal proportions the first language counts, languages being
    sorted by name; an empty table gives an empty result.
    """
    langs, table = train(docs.where(~is_held_out()))
    out = predict(docs, langs, table)
    return out.select("doc_id", is_held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__lang_set").alias("lang_set"))


def medians(rows: DataFrame, key: str, value: str, slots: int = SLOTS) -> dict[str, float]:
    """The exact median of each key's values, all counted, for as many keys as there are languages.

    A pass counts the values between bounds that hold the median in equal slots, and the slot with the median has
    the next bounds, until its values are equal. The driver gets at most ``slots`` rows a key.
    """
    out, bounds = {}, {}
    for k, low, high, n in rows.groupBy(key).agg(F.min(value), F.max(value), F.count(value)).collect():
        bounds[k] = low, high, (n - 1) // 2, n // 2  # of an even number of values the middle two count
    while True:
        out |= {k: low for k, (low, high, *_) in bounds.items() if low == high}
        bounds = {k: b for k, b in bounds.items() if b[0] < b[1]}
        if not bounds:
            return out
        own = F.create_map(*[x for k, b in bounds.items() for x in (F.lit(k), F.array(F.lit(b[0]), F.lit(b[1])))])[F.col(key)]
        inside = rows.select(key, F.col(value).alias("__x"), own[0].alias("__low"), own[1].alias("__high")).where("__x BETWEEN __low AND __high")
        slot = F.least(F.floor((F.col("__x") - F.col("__low")) / (F.col("__high") - F.col("__low")) * slots), F.lit(slots - 1))
        found: dict[str, list] = {}
        for k, s, n, low, high in inside.groupBy(key, slot.alias("__slot")).agg(F.count("*"), F.min("__x"), F.max("__x")).collect():
            found.setdefault(k, []).append((s, n, low, high))
        for k, (_, _, first, second) in list(bounds.items()):
            before, lower = 0, None
            for _, n, low, high in sorted(found[k]):
                if lower is not None:  # the middle two are one slot's last value and the next one's first
                    out[k] = (lower + low) / 2
                    del bounds[k]
                    break
                if first < before + n:
                    if second < before + n:
                        bounds[k] = low, high, first - before, second - before
                        break
                    lower = high
                before += n


def usual_fit(docs: DataFrame, langs: list[str], log_prob: np.ndarray) -> dict[str, tuple[float, float, float]]:
    """For each language how documents fit that the model was not trained on: the median, its deviation
    between documents and that between trigrams. All rows with text and non-null ``lang`` count whose language the
    model finds; their fits are written, and the driver gets counts."""
    if not langs:
        return {}
    scratch = Scratch(docs.sparkSession)
    held = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    seen = predict(held, langs, log_prob, ["lang"], fit=True).where(F.col("__lang_pred") == F.col("lang"))
    with bounded_batches(docs.sparkSession):
        seen = scratch.cut(seen.select("lang", "__fit", "__sd"), "fits")

    def spread(rows: DataFrame) -> dict[str, tuple[float, float, float]]:
        middle, within = medians(rows, "lang", "__fit"), medians(rows, "lang", "__sd")
        if not middle:
            return {}
        known = F.create_map(*[F.lit(x) for kv in middle.items() for x in kv])[F.col("lang")]
        away = medians(rows.select("lang", F.abs(F.col("__fit") - known).alias("__away")), "lang", "__away")
        return {x: (middle[x], max(LEAST_SPREAD, 1.4826 * away[x]), within[x]) for x in middle}

    counts = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    enough = [x for x in langs if counts.get(x, 0) >= LEAST_HELD]
    found = spread(seen.where(F.col("lang").isin(enough))) if enough else {}
    if len(enough) < len(langs) and sum(counts.values()) >= LEAST_HELD:
        found = dict.fromkeys(langs, spread(seen.withColumn("lang", F.lit("")))[""]) | found
    scratch.clear()
    return found


#: Names that predictions have; columns of these names are renamed while documents are judged.
OWN_NAMES = ("__lang_pred", "__score", "__lang_set", "__fit", "__sd", "__trigrams", "__text")


def keep_identified(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Documents with an identified language; those without letters go, and so do those whose trigrams are
    less likely in their language, by ``margin`` deviations, than those of its held-out documents.

    The deviation grows as the text gets shorter, and the rule does not depend on how many languages
    there are. Texts of a few words are therefore kept unless they are far off. Null and empty texts go,
    repeated rows stay or go together, other columns may have any names, an empty table stays empty; where nothing
    can be learned no language is known and all documents go.
    """
    columns = list(docs.columns)
    clash = [c for c in columns if c.lower() in OWN_NAMES]
    free = dict(zip(clash, free_names([*columns, *OWN_NAMES], *clash)))
    docs = docs.withColumnsRenamed(free)
    learned = docs.select("doc_id", "text", "lang")
    langs, table = train(learned.where(~is_held_out()))
    usual = usual_fit(learned.where(is_held_out()), langs, table)
    out = predict(docs, langs, table, docs.columns, fit=True).where(F.col("__lang_pred") != "und")
    if usual:
        known = F.create_map(*[x for k, f in usual.items() for x in (F.lit(k), F.array(*map(F.lit, f)))])[F.col("__lang_pred")]
        deviation = F.sqrt(known[1] ** 2 + known[2] ** 2 * OVERLAP / F.col("__trigrams"))
        out = out.where(F.coalesce(F.col("__fit") >= known[0] - margin * deviation, F.lit(True)))
    return out.select(*[F.col(f"`{free.get(c, c)}`").alias(c) for c in columns])
