"""Language-model scores of whole texts, with a unigram baseline.

The model draws each word, the end of the text included, from

    sum_k g_k(context) (known * W_k(word) + (1 - known) * S_k(word)).

g and S are those of `attention_lm`, over subword ids: a gate by causal
self-attention over overlapping windows, and a spelling of any word by ids. W_k
is the word's share in component k over all training text; `known`, the share of
words to expect that were seen, is by Good and Turing 1 minus the share of words
seen once.

1. A bounded sample of training texts (`SAMPLE_DOCS`, the smallest hashes of
   doc_id, `SAMPLE_CHARS` of each) starts the model on the driver; what is learned
   comes from the next step, over whole texts.
2. One pass over all training texts counts words, each with the mean posterior
   of its components, gathers the expected counts of ids by component, and trains
   the attention: each task steps on all its windows from the start, and the
   tasks' parameters are averaged by the words they were trained on. They depend
   on how rows are dealt.
3. One pass over all texts scores them. Words whose share of the corpus is at
   least 1/FREQUENT (so at most FREQUENT of them) are looked up in the task; the
   others are joined with their counts by a 64-bit hash of the word. No training
   word among these is frequent; one that is frequent in held-out texts only is
   left to the skew join of adaptive execution, which splits it.

A word is ids of its own: a blank and its lower-cased characters, in pieces of
LONGEST_WORD characters, by a public byte pair vocabulary. A task holds at most
HELD_WORDS distinct words and one text at a time besides.

Defined results: a null text counts as empty and is its end token alone; a null
doc_id counts as the empty text for the split, so it is held out; repeated rows
are scored one by one; without any training text the counts are 0 and the base
score is undefined only if nothing at all can be drawn, so N and V are 0 and
each token scores log10(0.1 / 0.1) = 0; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import math
import pickle
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import attention_lm as lm
from weftline.llm.common import cut, table

#: Texts that start the model, and the characters of each that are read for it.
SAMPLE_DOCS, SAMPLE_CHARS = 500, 20_000
FREQUENT = 400_000
FOLDS = 10
END_WORD = b"\n"  # no word contains white space
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END_ID, START_ID, VOCABULARY_SIZE = 50_256, 50_257, 50_258
#: Longer words are tokenized in pieces, as merging is slow on long runs.
LONGEST_WORD = 2_000
#: Distinct words that a task holds before it hands its counts on.
HELD_WORDS = 200_000
#: Words of texts that are worked on together, windows of a batch, bytes of a long text that are split at once.
CHUNK, BATCH, PIECE = 100_000, 1024, 1 << 22


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)) == 0


def _held(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def words(text: str) -> list[bytes]:
    """Lower case for A-Z, split at ASCII white space, then the end."""
    out = text.encode().lower().split()
    out.append(END_WORD)
    return out


def _pieces(text: bytes):
    """`text` cut at white space into pieces of about PIECE bytes."""
    at = 0
    while len(text) - at > PIECE and (gap := re.compile(rb"\s").search(text, at + PIECE)):
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def begins(path: str) -> np.ndarray:
    """Which ids begin a word: those whose bytes start with a blank, the end and the start."""
    enc, out = encoder(path), np.zeros(VOCABULARY_SIZE, bool)
    for i in range(enc.n_vocab):
        try:
            out[i] = enc.decode_single_token_bytes(i)[:1] == b" "
        except KeyError:
            pass
    out[[END_ID, START_ID]] = True
    return out


def word_ids(path: str, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, places at which the words begin) of distinct words."""
    enc, mark = encoder(path), begins(path)
    text = b" " + b" ".join(new)
    if max(map(len, new)) <= LONGEST_WORD and END_WORD not in new:
        plain = text.decode()
        if len(plain.split()) == len(new):  # no other white space, so no word depends on its neighbours
            ids = np.array(enc.encode_ordinary(plain), np.int32)
            at = np.nonzero(mark[ids])[0]
            if len(at) == len(new):
                return ids, at
    each = []
    for w in new:
        word = w.decode()
        parts = [word[k : k + LONGEST_WORD] for k in range(LONGEST_WORD, len(word), LONGEST_WORD)]
        rest = [i for p in parts for i in enc.encode_ordinary(p)]
        each.append([END_ID] if w == END_WORD else enc.encode_ordinary(" " + word[:LONGEST_WORD]) + rest)
    sizes = np.array([len(x) for x in each])
    return np.array([i for x in each for i in x], np.int32), np.cumsum(sizes) - sizes


class Lexicon(dict):
    """Numbers of the distinct words of a task; 0 is the end, 1 the start. Rows of `e`, `rel` and `top` are the words' embeddings, exp(log S - top) and largest log S."""

    def __init__(self, model: lm.Model, path: str):
        super().__init__()
        self.model, self.path = model, path
        self.order: list[bytes] = []
        self.size = 0
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.e, self.rel, self.top = np.empty((0, lm.K), np.float32), np.empty((0, lm.K), np.float32), np.empty(0, np.float32)
        self[END_WORD]
        self[b""]  # the start; no word is empty
        self.grow()

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.order.append(word)
        return n

    def grow(self) -> list[bytes]:
        """Take in the words met since; they are returned."""
        new, first = self.order[self.size :], self.size
        if new:
            ids, at = (np.array([END_ID, START_ID], np.int32), np.arange(2)) if not first else word_ids(self.path, new)
            e, s = self.model.words(ids, at)
            top = s.max(1)
            for name, x in (("e", e), ("rel", np.exp(s - top[:, None])), ("top", top)):
                held = getattr(self, name)
                if len(held) < first + len(new):
                    more = np.empty((max(2 * len(held), first + len(new)), *held.shape[1:]), np.float32)
                    more[:first] = held[:first]
                    setattr(self, name, held := more)
                held[first : first + len(new)] = x
            self.parts.append((ids, np.diff(at, append=len(ids))))
            self.size = len(self.order)
        return new

    def numbers(self, text: str) -> np.ndarray:
        """A text's words and its end."""
        parts = [np.fromiter(map(self.__getitem__, ws), np.int32, len(ws)) for ws in map(bytes.split, _pieces(text.encode().lower()))]
        return np.concatenate([*parts, np.zeros(1, np.int32)])


def _sequence(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers with a start before each text and one at the end, places, scored) of the windows of texts."""
    start = np.ones(1, np.int32)
    places, scored = lm.many_windows(np.array([len(t) for t in texts]))
    return np.concatenate([x for t in texts for x in (start, t)] + [start]), places, scored


def _chunks(batches, lexicon):
    """(doc_ids, numbers) of texts, about CHUNK words at a time."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(lexicon().numbers(text.as_py() or ""))
            size += len(texts[-1])
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _arrow(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


GATHERED = "word binary, n long, share long, id int, stats array<double>"
_GATHERED = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("share", pa.int64()), ("id", pa.int32()), ("stats", pa.list_(pa.float64()))])
SCORED = "rid long, doc_id long, n_tokens long, n_known long, base double, score double, hash long, spelt float, gate long"
_SCORED = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("hash", pa.int64()), ("spelt", pa.float32()), ("gate", pa.int64())]
)


def _packed(x: np.ndarray) -> np.ndarray:
    """Rows of K = 8 shares as bytes of one long."""
    return np.ascontiguousarray(x * 255).astype(np.uint8).view(np.int64).ravel()


def gather(docs: DataFrame, model, path: str) -> DataFrame:
    """In parts, of all rows of `docs` (doc_id, text): word counts with the mean posterior (word, n, share), expected counts (id, stats), and the trained attention times its words (n, stats)."""

    def count(batches):
        m = pickle.loads(model.value)
        of, trained, lexicon = np.zeros((VOCABULARY_SIZE, lm.K)), 0, Lexicon(m, path)
        times, share = np.zeros(0, np.int64), np.zeros((0, lm.K), np.float32)

        def tell():
            nonlocal of
            used = np.nonzero(times)[0]
            mean = share[used] / times[used, None]
            mean /= mean.sum(1, keepdims=True)
            for k in range(0, len(used), 50_000):
                some, none = used[k : k + 50_000], [None] * len(used[k : k + 50_000])
                yield _arrow([[lexicon.order[i] for i in some], times[some], _packed(mean[k : k + 50_000]), none, none], _GATHERED)
            ids, sizes = (np.concatenate(x) for x in zip(*lexicon.parts, strict=True))
            weight = np.zeros((len(lexicon), lm.K), np.float32)
            weight[: len(share)] = share
            of += np.stack([np.bincount(ids, np.repeat(weight[:, k], sizes), minlength=VOCABULARY_SIZE) for k in range(lm.K)], axis=1)

        for _, texts in _chunks(batches, lambda: lexicon):
            lexicon.grow()
            seq, places, scored = _sequence(texts)
            found = []
            for k in range(0, len(places), BATCH):
                at = places[k : k + BATCH]
                found.append(m.learn(lexicon.e[seq[at]], lexicon.rel[seq[at + 1]], scored[k : k + BATCH]))
            flat, found = np.concatenate(texts), np.concatenate(found)
            trained += len(flat)
            if len(times) < len(lexicon):
                times = np.concatenate([times, np.zeros(len(lexicon) - len(times), np.int64)])
                share = np.concatenate([share, np.zeros((len(lexicon) - len(share), lm.K), np.float32)])
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            at = np.nonzero(np.diff(flat, prepend=-1))[0]
            times[flat[at]] += np.diff(at, append=len(flat))
            share[flat[at]] += np.add.reduceat(found[order], at, axis=0)
            if len(lexicon) >= HELD_WORDS:
                yield from tell()
                lexicon = Lexicon(m, path)
                times, share = times[:0], share[:0]
        if len(times):
            yield from tell()
        if trained:
            yield _arrow([[None], [trained], [None], [None], [(m.flat() * trained).tolist()]], _GATHERED)
        used = np.nonzero(of.sum(1))[0]
        for k in range(0, len(used), 5000):
            at, none = used[k : k + 5000], [None] * len(used[k : k + 5000])
            yield _arrow([none, none, none, at, of[at].tolist()], _GATHERED)

    return docs.mapInArrow(count, GATHERED)


def trained_gate(gathered: DataFrame, start: lm.Model) -> tuple[dict[str, np.ndarray], int]:
    """(attention averaged over the tasks, words it was trained on); that of `start` where there are none."""
    rows = gathered.where("word is null and id is null")
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        return start.gate, 0
    sums = rows.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    return lm.Model.gate_of(np.array([r.x for r in sums]) / n), n


class Frequent:
    """The words that tasks look up: their numbers, base values and shares in the components."""

    def __init__(self, words: list[bytes], value: np.ndarray, share: np.ndarray):
        self.number = {w: k for k, w in enumerate(words)}
        self.value, self.share = value, share


def apply(docs: DataFrame, model, frequent, known: float, path: str) -> DataFrame:
    """One row per document with what the frequent words give, and one per occurrence of another word: log10 of its spelling's part, and the gate."""

    def score(batches):
        m, top = pickle.loads(model.value), frequent.value
        first, lexicon = TaskContext.get().partitionId() << 40, Lexicon(m, path)
        place, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for doc_ids, texts in _chunks(batches, lambda: lexicon):
            lexicon.grow()
            new = lexicon.order[len(place) :]
            found = np.array([top.number.get(w, -1) for w in new], np.int64)
            place = np.concatenate([place, found])
            hashes = np.concatenate([hashes, np.array([xxhash.xxh64_intdigest(w, 42) if k < 0 else 0 for w, k in zip(new, found, strict=True)], np.uint64).view(np.int64)])
            seq, places, scored = _sequence(texts)
            sizes = np.array([len(t) for t in texts])
            flat, doc = np.concatenate(texts), np.repeat(np.arange(len(texts)), sizes)
            at_top = place[flat]
            base = np.bincount(doc, np.where(at_top >= 0, top.value[at_top] if len(top.value) else 0.0, 0.0), minlength=len(texts))
            n_known = np.bincount(doc[at_top >= 0], minlength=len(texts))
            total, done = np.zeros(len(texts)), 0
            for k in range(0, len(places), 8 * BATCH):
                g = m.scored_gates(lexicon.e, seq[places[k : k + 8 * BATCH]], scored[k : k + 8 * BATCH])
                here = slice(done, done := done + len(g))
                w, d, which = flat[here], doc[here], at_top[here]
                spelt = (lexicon.top[w] + np.log(np.maximum((g * lexicon.rel[w]).sum(1), np.float32(1e-37)))) / math.log(10) + math.log10(1 - known)
                seen = which >= 0
                counted = np.log10(known * np.maximum((g[seen] * top.share[which[seen]]).sum(1), 1e-37))
                total += np.bincount(d[seen], np.logaddexp2(counted * math.log2(10), spelt[seen] * math.log2(10)) / math.log2(10), minlength=len(texts))
                rare = np.nonzero(~seen)[0]
                if len(rare):
                    gaps = (pa.nulls(len(rare), f.type) for f in list(_SCORED)[1:6])
                    yield pa.RecordBatch.from_arrays([pa.array(first + d[rare]), *gaps, pa.array(hashes[w[rare]]), pa.array(spelt[rare], pa.float32()), pa.array(_packed(g[rare]))], schema=_SCORED)
            none = [None] * len(texts)
            yield _arrow([first + np.arange(len(texts)), doc_ids, sizes, n_known, base, total, none, none, none], _SCORED)
            first += len(texts)
            if len(lexicon) >= HELD_WORDS:
                lexicon = Lexicon(m, path)
                place, hashes = place[:0], hashes[:0]

    return docs.mapInArrow(score, SCORED)


def _by_component(packed: Column) -> list[Column]:
    return [F.shiftrightunsigned(packed, 8 * k).bitwiseAND(F.lit(255).cast("long")) for k in range(lm.K)]


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of `docs`."""
    spark, path = docs.sparkSession, vocabulary or vocabulary_path()
    sc = spark.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    train = rows.where(~held_out(F.col("doc_id")))
    # ids first: a top list of whole texts would bring SAMPLE_DOCS texts of every task to the driver
    ids = [r.doc_id for r in train.groupBy("doc_id").agg(F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(SAMPLE_DOCS).collect()]
    sample = train.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).orderBy("doc_id").collect()
    lexicon_ids = lambda t: np.concatenate([word_ids(path, ws)[0] for ws in [words(t)[:-1]] if ws] + [np.array([END_ID], np.int32)])
    model = lm.fit([lexicon_ids(r.text or "") for r in sample], VOCABULARY_SIZE, START_ID, begins(path))

    gathered = cut(gather(train, sc.broadcast(pickle.dumps(model)), path), "gathered")
    sums = [F.sum(F.get("stats", F.lit(k))).alias(f"s{k}") for k in range(lm.K)]
    of = np.zeros((VOCABULARY_SIZE, lm.K))
    for r in gathered.where("id is not null").groupBy("id").agg(*sums).collect():  # as many rows as ids
        of[r[0]] = r[1:]
    model = lm.Model(lm.table(of), trained_gate(gathered, model)[0])

    each = [F.sum(F.col("n") * b).alias(f"c{k}") for k, b in enumerate(_by_component(F.col("share")))]
    counts = cut(gathered.where("word is not null").groupBy("word").agg(F.sum("n").alias("c"), *each), "words")
    names = [f"c{k}" for k in range(lm.K)]
    n, v, once, *of_k = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.count(F.when(F.col("c") == 1, 1)), *(F.coalesce(F.sum(k), F.lit(0)) for k in names)).first()
    known = min(0.99, max(0.01, 1 - once / max(1, n)))
    top = counts.where(F.col("c") * FREQUENT >= n).toArrow()  # at most FREQUENT words
    c = np.stack([top.column(k).to_numpy().astype(np.float64) for k in names], axis=1) / np.maximum(1, np.array(of_k, np.float64))
    value = np.log10((top.column("c").to_numpy() + 0.1) / (n + 0.1 * (v + 1)))
    frequent = Frequent([bytes(w) for w in top.column("word").to_pylist()], value, c.astype(np.float32))
    scored = cut(apply(rows, sc.broadcast(pickle.dumps(model)), sc.broadcast(frequent), known, path), "scored")

    rare = counts.where(F.col("c") * FREQUENT < n).groupBy(F.xxhash64("word").alias("hash")).agg(*(F.sum(k).alias(k) for k in ("c", *names)))
    joined = scored.where("hash is not null").select("rid", "hash", "spelt", "gate").join(rare, "hash", "left")
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(n + 0.1 * (v + 1)))
    part = sum((b * F.col(k) / F.lit(float(max(1, t)) * 255) for b, k, t in zip(_by_component(F.col("gate")), names, of_k, strict=True)), F.lit(0.0))
    joined = joined.select("rid", "c", term.alias("term"), F.col("spelt").cast("double").alias("s"), F.when(F.col("c").isNotNull(), F.log10(F.lit(known) * part)).alias("w"))
    both = F.greatest("s", "w") + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), -F.abs(F.col("s") - F.col("w"))))
    more = joined.groupBy("rid").agg(F.sum("term").alias("more"), F.sum(F.when(F.col("c") > 0, 1).otherwise(0)).alias("also"), F.sum(F.coalesce(both, "s")).alias("others"))
    out = scored.where("hash is null").join(more, "rid", "left")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("others", F.lit(0.0))).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
