"""Texts that were broken off.

1. *Copies.* Texts with equal words count as one. Shingles of five words get min-hash signatures, cut into bands. In each
   band bucket a text is compared with the longest one, then with the next two, four and so on, until a longer text
   holds 0.8 of its shingles or it has met every longer one; the two are aligned at the end of the shorter one. Where the
   longer copy goes on inside the sentence or word, the shorter one was broken off; where it ends a sentence there, the
   shorter one is whole.
2. *Terminality.* For the other texts a logistic model scores how far the closing words end a sentence. It is fitted on
   sentences of a bounded sample of texts: whole ones, and the same ones cut at random letters.
3. *Limits.* A field limit shows as a length, in characters or bytes, that far more of a source's texts have than have
   the neighbouring lengths; it raises the prior odds that a text of that length was cut.

Each text is read twice: by one pass that takes its word hashes, signature and closing words, and, where it is in the
sample or shares a bucket, by one that fetches it.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstead.session import cut, sized_broadcast

#: Marks that may be put after a text wherever it ends.
MARKS = r"[\s…�*]+|\.{2,}|[-–—]+$"
SHINGLE, BANDS, ROWS, LIKE, SEED = 5, 16, 6, 0.8, 5
#: Texts whose sentences the model is fitted on, examples taken of them at most, and the size of its weight table.
SAMPLE_TEXTS, EXAMPLES, DIM = 3000, 400_000, 1 << 18
#: Share of all texts with the same three last words from which these count as an end, and texts it takes at least.
CLOSING_SHARE, CLOSING_TEXTS = 4 / 3000, 4
#: Most that a full stop, or its absence, counts for.
MOST_STOP = 1.0
#: Most ids of texts that are broadcast to fetch them; pairs of one text from which they are spread; characters hashed at once.
PAIR_ROWS, HUB, CHARS = 1_000_000, 20_000, 1 << 20
ALIGNED = T.StructType([T.StructField("near", T.BooleanType()), T.StructField("aligned", T.IntegerType())])
_STOP = re.compile(r"(?<=[.!?:׃])[\"'”)\]]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:[\"'׳״־-][^\W_]+)*['׳]?")
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_TRAIL = _BLANKS + "…\ufffd*-–—\"”"
_POINTS = re.compile("[֑-ֽֿ-ׇ‎‏]")


def stripped(text: str) -> str:
    """Without the blanks and marks that may follow a break; one full stop stays, two or more go."""
    body = text.rstrip(_TRAIL)
    while body.endswith(".."):
        body = body.rstrip(".").rstrip(_TRAIL)
    return body


def last_sentence(text: str) -> tuple[list[str], str]:
    """Words since the last stop, and the stop that ends the text if any; a text that ends in a stop gives that sentence."""
    body = stripped(text)
    end = body[-1:] if body[-1:] in ".!?)]:׃" else ""
    body = body.rstrip(".!?)]:׃\"'” ")
    at, start = 0, len(body)
    while start and not at:  # the last stop is looked for from the end, in ever longer parts
        start = max(0, 4 * start - 3 * len(body) - 400)
        for m in _STOP.finditer(body, start):
            at = m.end()
    return _WORD.findall(_POINTS.sub("", body[at:]).lower()), end


def _hash(part: str) -> int:
    return zlib.crc32(part.encode()) % DIM


def features(w: list[str]) -> list[int]:
    """Hashed features of a segment: its closing words alone and together, and what it opened with and holds."""
    if not w:
        return [_hash("empty")]
    out = [f"n{min(len(w), 40) // 2}", f"f{w[0]} {min(len(w), 40) // 3}", f"l{w[-1]}"]
    tail = w[-6:][::-1]
    out += [f"{d}:{x}" for d, x in enumerate(tail)]
    out += [f"b{a} {b}" for a, b in zip(tail, tail[1:])]
    out.append("t" + " ".join(tail[:3]))
    out.append(f"g{tail[0]} {tail[2] if len(tail) > 2 else ''}")
    head = " ".join(w[:2]) if len(w) > 1 else w[0]
    out += [f"h{head}|{d}:{x}" for d, x in enumerate(tail[:4])]
    out += [f"p{w[0]}|{x}" for x in set(w[-14:])]
    return [_hash(x) for x in out]


def closing(text: str) -> str:
    """The last three words of a text's last sentence."""
    return " ".join(last_sentence(text)[0][-3:])


def common_ends(read: DataFrame) -> set[str]:
    """Closing words of ``CLOSING_SHARE`` of all texts or more, counted over all; no more than ``1 / CLOSING_SHARE`` of them.

    ``read (key, words)``, equal keys equal texts, which count once."""
    each = read.dropDuplicates(["key"])
    least = max(CLOSING_TEXTS, math.ceil(CLOSING_SHARE * each.count()))
    return {r["words"] for r in each.groupBy("words").agg(F.count("*").alias("c")).where(F.col("c") >= least).collect()}


def _examples(text: str, ends: set[str], seed: int) -> list[tuple[list[int], float]]:
    """Features and labels of a text's sentences, whole and cut at random; the same for the same text."""
    rng, out = np.random.default_rng([seed, zlib.crc32(text.encode())]), []
    spots = [m for m in _STOP.finditer(text) if m.group()[0] != "\n"]
    starts = [0, *[m.end() for m in spots]]
    for a, b in zip(starts, [m.start() for m in spots]):
        if 20 <= b - a <= 1500:
            out.append((features(last_sentence(text[a:b])[0]), 1.0))
            for _ in range(2):
                k = a + int(rng.integers(3, max(4, b - a - 2)))
                out.append((features(last_sentence(text[a:k])[0]), 0.0))
    # a text's own end counts where others end so too, as closing lines do; a broken one rarely has its like
    if closing(text) in ends:
        out.append((features(last_sentence(text)[0]), 1.0))
    return out


def fit(rows: list[list[int]], label: np.ndarray, seed: int = SEED, epochs: int = 4) -> np.ndarray:
    """Weights of the terminality model by adaptive gradient steps; the last weight is the intercept."""
    w, g = np.zeros(DIM + 1), np.full(DIM + 1, 1e-6)
    if not len(rows):
        return w
    lengths = np.array([len(r) for r in rows])
    flat, ends = np.concatenate([np.asarray(r, np.int64) for r in rows]), np.cumsum(lengths)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            n = lengths[batch]
            at = np.repeat(ends[batch] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids, owner = flat[at], np.repeat(np.arange(len(batch)), n)
            score = w[DIM] + np.bincount(owner, w[ids], minlength=len(batch))
            err = 1.0 / (1.0 + np.exp(-np.clip(score, -30, 30))) - label[batch]
            used, inverse = np.unique(ids, return_inverse=True)
            grad = np.bincount(inverse, err[owner]) + 1e-3 * w[used]
            g[used] += grad**2
            w[used] -= 0.3 * grad / np.sqrt(g[used])
            top = err.sum() + 1e-3 * w[DIM]
            g[DIM] += top**2
            w[DIM] -= 0.3 * top / np.sqrt(g[DIM])
    return w


_kinds: list[np.ndarray] = []


def _char_kinds() -> np.ndarray:
    """Of each character whether it parts words (0), makes them (1) or is passed over inside them (2); made once a process."""
    if not _kinds:
        kinds = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            kinds[i] = 1 if c.isalnum() else 2 if unicodedata.category(c) == "Mn" or c in "'\"׳״’‘“”„`´\u200e\u200f\ufeff\xad" else 0
        _kinds.append(kinds)
    return _kinds[0]


def _word_hashes(texts: list[str]) -> list[np.ndarray]:
    """The hashes of each text's words, all texts at once; case, points, quotes and punctuation play no part."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _char_kinds()[codes]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    kept = kinds != 2
    codes, kinds, owner = codes[kept], kinds[kept], owner[kept]
    letter = kinds == 1
    first = letter & ~np.concatenate(([False], letter[:-1]))
    starts = np.flatnonzero(first[letter])
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    word = np.cumsum(first[letter]) - 1
    place = np.arange(len(word)) - starts[word]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
        hashes = np.add.reduceat((codes[letter].astype(np.uint64) + np.uint64(0x632BE59B)) * powers[place], starts)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.split(hashes, np.searchsorted(owner[letter][starts], np.arange(1, len(texts))))


_draw = np.random.default_rng(SEED)
_MULT, _ADD = _draw.integers(1, 2**31, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _draw.integers(0, 2**63, BANDS * ROWS, np.uint64)
_BAND_MULT = _draw.integers(1, 2**62, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(h: np.ndarray) -> list[int]:
    """Bucket keys of a text's word shingles, one a band; none for texts shorter than a shingle."""
    if len(h) < SHINGLE:
        return []
    s = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            s = s * np.uint64(6364136223846793005) + h[j : len(h) - SHINGLE + 1 + j]
        s = np.unique(s ^ (s >> np.uint64(29)))
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(s), 512):
            mixed = s[at : at + 512, None] * _MULT
            mixed += _ADD
            mixed ^= mixed >> np.uint64(32)
            np.minimum(low, mixed.min(axis=0), out=low)
        bands = (low.reshape(BANDS, ROWS) * _BAND_MULT).sum(axis=1, dtype=np.uint64)
        bands = (bands ^ (bands >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) + np.arange(BANDS, dtype=np.uint64)
        return bands.view(np.int64).tolist()


def _shingles(w: list[str]) -> set:
    return {tuple(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)}


def aligned_end(short: str, long: str) -> int | None:
    """1: ``short`` was broken off as against its near-copy ``long``, which holds 0.8 of its shingles; 0: it ends a sentence
    there; None: no near-copy, no end found in it, or both end at one place."""
    return _compared(short, long)[1]


def _compared(short: str, long: str) -> tuple[bool, int | None]:
    """Whether ``long`` is a near-copy, and what the alignment says."""
    plain = [_WORD.findall(_POINTS.sub("", stripped(t)).lower()) for t in (short, long)]
    a, b = plain
    sa = _shingles(a)
    if not sa or len(sa & _shingles(b)) < LIKE * len(sa):
        return False, None
    marked = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(_POINTS.sub("", long).lower())]
    for back in (0, 1):  # the last word may be a part of one
        key = a[len(a) - back - 4 : len(a) - back]
        spots = [k for k in range(len(b) - 3) if b[k : k + 4] == key]
        if not spots:
            continue
        k = max(spots, key=lambda s: -abs(s + 4 - (len(a) - back))) + 4
        if k >= len(marked):
            return True, None
        if back and not (b[k].startswith(a[-1]) and b[k] != a[-1]):
            continue
        if back:
            return True, 1
        gap = _POINTS.sub("", long)[marked[k - 1][2] : marked[k][1]]
        return True, 0 if re.search(r"[.!?\n:׃(\[…]", gap) else 1
    return True, None


@F.pandas_udf(ALIGNED)
def _align(short: pd.Series, long: pd.Series) -> pd.DataFrame:
    found = [_compared(a, b) for a, b in zip(short, long)]
    return pd.DataFrame({"near": [n for n, _ in found], "aligned": pd.array([a for _, a in found], dtype="Int32")})


def _copies(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """``(key, aligned)``: texts that a longer near-copy decides. ``signed (doc_id, key, n, sigs)``, equal keys equal texts;
    ``texts (doc_id, text)`` has their texts.

    Only texts that share a bucket are fetched. In round ``r`` those not yet settled meet the ``2 ** r`` next longest
    texts of their buckets, so a bucket of near-copies costs a comparison a text, and none is settled before a near-copy
    is found or all longer texts were met. A text that many are compared with is sent out in copies."""
    once = signed.groupBy("key").agg(F.min_by(F.struct("doc_id", "n", "sigs"), "doc_id").alias("s")).select("key", "s.*")
    banded = once.select("doc_id", "n", F.explode("sigs").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    banded = cut(banded.join(shared, "bucket"))
    wanted = cut(banded.select("doc_id").distinct())
    held = cut(texts.join(sized_broadcast(wanted, PAIR_ROWS), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")))
    longest_first = Window.partitionBy("bucket").orderBy(F.col("n").desc(), F.col("doc_id").desc())
    open_, settled, size = banded, None, 1
    while not open_.isEmpty():
        ranked = banded.withColumn("rank", F.row_number().over(longest_first)).where(F.col("rank") < 2 * size).join(open_.select("bucket").distinct(), "bucket", "left_semi")
        leaders = cut(ranked.where(F.col("rank") >= size).select("bucket", F.col("doc_id").alias("longer"), F.col("n").alias("m"), "rank"))
        pairs = open_.join(leaders, "bucket").where((F.col("m") > F.col("n")) | (F.col("m") == F.col("n")) & (F.col("longer") > F.col("doc_id"))).select("doc_id", "longer").distinct()
        met = cut(pairs.join(pairs.groupBy("longer").agg(F.ceil(F.count("*") / HUB).cast("int").alias("copies")), "longer").withColumn("salt", F.pmod(F.xxhash64("doc_id"), "copies").cast("int")))
        sent = met.groupBy("longer").agg(F.first("copies").alias("copies")).join(held.select(F.col("doc_id").alias("longer"), F.col("text").alias("long")), "longer").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        both = met.drop("copies").join(sent, ["longer", "salt"]).join(held.select("doc_id", F.col("text").alias("short")), "doc_id")
        told = cut(both.select("doc_id", _align("short", "long").alias("a")).select("doc_id", "a.*").where("near").groupBy("doc_id").agg(F.max("aligned").alias("aligned")))
        settled = told if settled is None else settled.unionByName(told)
        more = leaders.groupBy("bucket").agg(F.max("rank").alias("r")).where(F.col("r") == 2 * size - 1).select("bucket")
        open_ = cut(open_.join(told.select("doc_id"), "doc_id", "left_anti").join(leaders.select("bucket", F.col("longer").alias("doc_id")), ["bucket", "doc_id"], "left_anti").join(more, "bucket", "left_semi"))
        size *= 2
    if settled is None:
        settled = wanted.select("doc_id", F.lit(None).cast("int").alias("aligned"))
    return settled.where("aligned is not null").join(once.select("doc_id", "key"), "doc_id").groupBy("key").agg(F.max("aligned").alias("aligned"))


def _limits(ends: DataFrame) -> DataFrame:
    """``(source, unit, size, lift)``: lengths that stand out among their neighbours; a few rows a source."""
    sized = ends.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("u")).select("source", "u.*")
    counts = sized.groupBy("source", "unit", "size").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-60, 60)
    around = counts.withColumn("usual", (F.sum("n").over(near) - F.col("n")) / 120.0)
    return around.where((F.col("n") >= 6) & (F.col("n") > 6.0 * (F.col("usual") + 0.3))).select("source", "unit", "size", F.log((F.col("n") - F.col("usual")) / (F.col("usual") + 0.3)).alias("lift"))


def broken_off(docs: DataFrame, doc_id: str, text: str, source: str, prior: float = -2.0) -> DataFrame:
    """``(doc_id, source, broken, how, score)`` for each text, ``score`` the log-odds that it was broken off.

    Texts of equal characters are judged once. A null text or one of blanks only is never broken and has no score. A
    null source is a source of its own. A repeated id counts once, with the text of the largest digest. Texts may be of any
    length and are read whole. Without any text the result is empty. ``prior`` is the log-odds of a break for a text
    at no limit. Which words end a sentence is learnt from at most ``SAMPLE_TEXTS`` texts, those of the smallest hash;
    copies, common closing words, limits and scores cover all texts."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))

    @F.pandas_udf("struct<feats array<int>, words string, stop boolean, chars int, bytes int, n int, sigs array<bigint>>")
    def read_once(column: pd.Series) -> pd.DataFrame:
        texts, out, at = [t or "" for t in column], [], 0
        while at < len(texts):
            to, chars = at + 1, len(texts[at])
            while to < len(texts) and chars < CHARS:
                chars, to = chars + len(texts[to]), to + 1
            for t, h in zip(texts[at:to], _word_hashes(texts[at:to])):
                if not t.strip():
                    out.append((None,) * 7)
                    continue
                segment, stop = last_sentence(t)
                bare = t.rstrip("….")
                cut_ = t.rstrip(_BLANKS + "…\ufffd") if "\ufffd" in t[-3:] else bare
                chars = len(t.rstrip("…\ufffd.*- ")) if len(stripped(t)) < len(t) else len(t)
                out.append((features(segment), " ".join(segment[-3:]), stop != "", chars, len(cut_.encode("utf-8", "surrogatepass")), len(h), _signature(h)))
            at = to
        return pd.DataFrame(out, columns=["feats", "words", "stop", "chars", "bytes", "n", "sigs"]).astype({"chars": "Int32", "bytes": "Int32", "n": "Int32", "stop": "boolean"})

    kept = F.max(F.struct("key", "source", "e"))
    read = cut(base.select("doc_id", F.md5("text").alias("key"), "source", read_once("text").alias("e")).groupBy("doc_id").agg(kept.alias("k")).select("doc_id", "k.key", "k.source", "k.e.*"))
    unread, read = read.where("feats is null"), read.where("feats is not null")
    ends = common_ends(read.select("key", "words"))
    sample = read.groupBy("key").agg(F.min("doc_id").alias("doc_id")).orderBy("key").limit(SAMPLE_TEXTS)

    @F.pandas_udf("array<struct<feats array<int>, label double>>")
    def examples(column: pd.Series) -> pd.Series:
        return column.map(lambda t: _examples(t, ends, SEED))

    sampled = base.join(F.broadcast(sample), "doc_id").where(F.md5("text") == F.col("key")).dropDuplicates(["key"]).select("key", F.posexplode(examples("text")).alias("no", "x"))
    taken = sampled.orderBy(F.xxhash64("key", "no"), "key", "no").limit(EXAMPLES).select("x.*").toPandas()
    model = spark.sparkContext.broadcast(fit(taken["feats"].tolist(), taken["label"].to_numpy(float)).astype(np.float32))

    @F.pandas_udf("double")
    def terminal(column: pd.Series) -> pd.Series:
        w = model.value
        return column.map(lambda feats: float(w[DIM] + w[feats].sum())).astype("float64")

    scored = read.withColumn("terminal", terminal("feats")).drop("feats", "words", "n", "sigs")
    limits = _limits(scored)
    here = scored.select("doc_id", "source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("u")).select("doc_id", "source", "u.*")
    lifts = here.join(limits, ["source", "unit", "size"]).groupBy("doc_id").agg(F.max("lift").alias("lift"))
    marked = scored.join(lifts, "doc_id", "left").groupBy(F.col("lift").isNotNull().alias("limit")).agg(F.count_if("stop").alias("stops"), F.count("*").alias("n")).collect()
    share = {r["limit"]: (r["stops"] + 1.0) / (r["n"] + 2.0) for r in marked}
    cut_share, usual_share = share.get(True, share.get(False, 0.5)), share.get(False, share.get(True, 0.5))
    stop_odds = F.when(F.col("stop"), F.lit(math.log(cut_share / usual_share))).otherwise(F.lit(math.log((1 - cut_share) / (1 - usual_share))))
    judged = scored.join(lifts, "doc_id", "left").join(_copies(read.select("doc_id", "key", "n", "sigs"), base.select("doc_id", "text")), "key", "left")
    odds = F.col("terminal") * -1.0 + F.coalesce("lift", F.lit(prior)) + F.greatest(F.least(stop_odds, F.lit(MOST_STOP)), F.lit(-MOST_STOP))
    score = F.when(F.col("aligned") == 1, F.greatest(odds, F.lit(4.0))).when(F.col("aligned") == 0, F.least(odds, F.lit(-4.0))).otherwise(odds)
    judged = judged.select("doc_id", "source", F.round(score, 4).alias("score"), F.when(F.col("aligned").isNotNull(), F.lit("copy")).when(F.col("lift").isNotNull(), F.lit("limit")).otherwise(F.lit("closing words")).alias("how"))
    judged = judged.unionByName(unread.select("doc_id", "source"), allowMissingColumns=True)
    return judged.select("doc_id", F.nullif("source", F.lit("")).alias("source"), F.coalesce(F.col("score") > 0, F.lit(False)).alias("broken"), "how", "score")
