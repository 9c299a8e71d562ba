"""LM scoring with a sharded Elias-Fano n-gram trie (operator 2).

The model is a bigram model smoothed towards the unigrams: with counts c, N
training tokens of V kinds and u(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

    P(w | v) = (c(v, w) + mu u(w)) / (c(v) + mu)
             = u(w) * mu / (c(v) + mu) * (1 + c(v, w) / (mu u(w))).

A text is its words (A-Z lower-cased) and one end token, which is also the
context of the first word.  The tokens of a text and the contexts in it are
the same multiset, so its log10 probability is the sum of
log10 u(w) + log10(mu / (c(w) + mu)) over its tokens, plus
log10(1 + c(v, w) / (mu u(w))) over its pairs that training has seen.  The
first needs word counts (exact); the last is one number for each seen pair,
quantised to a byte and stored in the trie.

Steps, all over whole tables:

1. Words are counted: a task sends each shard the sorted word hashes and
   counts of its texts as an Elias-Fano sequence.
2. Pairs are counted the same way.  A pair goes to its word's shard, where the
   word's count is known; pairs of frequent words go by the hash of the pair.
   Each shard then holds a trie: contexts, pointers, successors and codes as
   buffers that are searched in place.
3. Texts are scored: words and pairs that make up 1 / 2**20 of the training
   tokens or more (there are 2**20 of each at most, and they are sent to all tasks)
   are resolved where the text is; the others are sent to their shards as
   Elias-Fano sequences with the number of the document and looked up; a
   shard answers a message with its documents' sums, and these are added.

So a frequent word or pair never gathers its rows in one shard, and the shards
grow in number, not in size.  All pairs are kept: there is no count cut-off.
Inside the trie words are known by 32 bits of their hash, which may very
rarely lend an unseen pair a seen pair's code; word counts use all 64.

Defined results: null and empty texts are the end token alone; a null id has
remainder 0; repeated rows train and score each; without training documents
every word has probability 1; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballot.llm import words as W
from ballot.llm.elias_fano import Sequence, Trie, encode
from ballot.llm.graph import staged

MU = 5_000.0
#: Training tokens for each shard.
SHARD_TOKENS = 4_000_000
#: Tokens that a task gathers before it sends them.
FLUSH_TOKENS = 2_000_000
#: Words and pairs with a larger share of the tokens are sent to all tasks: 2**20 at most.
FREQUENT = 1 << 20
STEP = 25.0  # codes for one power of ten
END = np.uint64(0x656E645F6F665F74)
_MAX_DOCS = 1 << 16


def _streams(batches):
    """(first row, token hashes with an end token after each text, document
    number of each token) of slices of batches."""
    for batch in batches:
        data, off = W.utf8(batch.column(1))
        for a, b in W.slices(batch.num_rows, off, 1 << 20):
            part = data[off[a] : off[b]]
            starts, ends, first = W.word_bounds(part, off[a : b + 1] - off[a])
            n = np.diff(first)
            stream = np.full(len(starts) + b - a, END, np.uint64)
            doc = np.repeat(np.arange(b - a), n + 1)
            stream[np.arange(len(starts)) + np.repeat(np.arange(b - a), n)] = W.word_hashes(part, starts, ends)
            yield batch, a, b, stream, doc


def _pairs(stream: np.ndarray) -> np.ndarray:
    high = stream >> np.uint64(32)
    return np.append(END >> np.uint64(32), high[:-1]) << np.uint64(32) | high


def _counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and the sums of their counts."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n[order], new) if len(keys) else n[:0]


def _word_shard(high: np.ndarray, shards: int) -> np.ndarray:
    return (W.mix(high) % np.uint64(shards)).astype(np.int32)


def _by_shard(shard: np.ndarray, shards: int):
    """(shard, indices in their order) of every shard that occurs."""
    order = np.argsort(shard, kind="stable")
    cut = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.unique(shard).tolist():
        yield s, order[cut[s] : cut[s + 1]]


class Frequent:
    """Sorted keys with a value each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(q), np.int64), np.zeros(len(q), bool)
        i = np.searchsorted(self.keys, q)
        i[i == len(self.keys)] = 0
        return i, self.keys[i] == q


class Model:
    """What every task knows: totals, frequent words and frequent pairs."""

    def __init__(self, n: int, v: int, shards: int, words: Frequent, mu: float):
        self.n, self.v, self.shards, self.words, self.mu = n, v, shards, words, mu
        high, count = _counted(words.keys >> np.uint64(32), words.values)
        self.high = Frequent(high, count)
        self.pairs = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.uint8))

    def log_u(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.n + 0.5 * (self.v + 1)))

    def log_rest(self, c: np.ndarray) -> np.ndarray:
        return np.log10(self.mu / (c + self.mu))

    def pair_shard(self, pairs: np.ndarray) -> np.ndarray:
        high = pairs & np.uint64(0xFFFFFFFF)
        _, hot = self.high.find(high)
        return np.where(hot, _word_shard(pairs, self.shards), _word_shard(high, self.shards))


def _count_rows(batches, keys_of, shard_of, shards):
    """Messages (shard, keys, counts) of the keys of all texts of a task."""
    held, size = [], 0

    def flush():
        keys, n = _counted(*(np.concatenate(x) for x in zip(*held)))
        rows = [(s, encode(keys[i]), n[i].astype("<u4").tobytes()) for s, i in _by_shard(shard_of(keys), shards)]
        s, k, c = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], names=["shard", "keys", "counts"])

    for *_, stream, _doc in _streams(batches):
        held.append(_counted(keys_of(stream)))
        size += len(held[-1][0])
        if size > 2 * FLUSH_TOKENS:
            # repeats shrink what is held; it is sent when they no longer do
            held = [_counted(*(np.concatenate(x) for x in zip(*held)))]
            size = len(held[0][0])
            if size > FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all messages to a shard."""
    if not table.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([Sequence(x.as_buffer()).values() for x in table["keys"]])
    n = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table["counts"]])
    return _counted(keys, n.astype(np.int64))


def _counts(keys: np.ndarray, n: np.ndarray) -> dict:
    return {"keys": [encode(keys)], "counts": [n.astype("<i8").tobytes()]}


_MESSAGE = "shard int, keys binary, counts binary"


def _train(texts: DataFrame, mu: float, shards: int) -> tuple[Model, DataFrame, DataFrame]:
    """(model, word shards, trie shards) from (id, text) rows."""

    def word_messages(batches):
        yield from _count_rows(batches, lambda s: s, lambda k: _word_shard(k >> np.uint64(32), shards), shards)

    def merge_words(key, table):
        keys, n = _merged(table)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), **_counts(keys, n), "n": [int(n.sum())], "v": [len(keys)]})

    words = staged(texts.mapInArrow(word_messages, _MESSAGE).groupBy("shard").applyInArrow(merge_words, _MESSAGE + ", n long, v long"), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    least = max(2, -(-n // FREQUENT))

    def frequent_words(batches):
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                count = np.frombuffer(c.as_buffer(), "<i8")
                often = count >= least
                yield pa.RecordBatch.from_arrays([pa.array(Sequence(k.as_buffer()).values()[often].view(np.int64)), pa.array(count[often])], names=["key", "value"])

    model = Model(n, v, shards, _collect(words.select("keys", "counts").mapInArrow(frequent_words, "key long, value long")), mu)

    def pair_messages(batches):
        yield from _count_rows(batches, _pairs, model.pair_shard, shards)

    def build(key, messages, own):
        keys, c = _merged(messages)
        high = keys & np.uint64(0xFFFFFFFF)
        if own.num_rows:
            known = np.concatenate([Sequence(x.as_buffer()).values() for x in own["keys"]]) >> np.uint64(32)
            here = Frequent(*_counted(known, np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in own["counts"]])))
        else:
            here = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
        count = np.zeros(len(keys))
        for table in (here, model.high):
            i, found = table.find(high)
            count[found] = table.values[i[found]]
        gain = np.log10(1 + c / (mu * 10.0 ** model.log_u(count)))
        codes = np.minimum(np.rint(gain * STEP), 255).astype(np.uint8)
        often = c >= least
        levels = Trie.build(keys, codes)
        names = ("contexts", "pointers", "successors", "codes")
        out = {"shard": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array([x], pa.binary()) for k, x in zip(names, levels)}}
        return pa.table(out | {"often": pa.array([keys[often].tobytes()], pa.binary()), "often_codes": pa.array([codes[often].tobytes()], pa.binary())})

    layout = "shard int, contexts binary, pointers binary, successors binary, codes binary, often binary, often_codes binary"
    pairs = texts.mapInArrow(pair_messages, _MESSAGE).groupBy("shard").cogroup(words.select("shard", "keys", "counts").groupBy("shard"))
    tries = staged(pairs.applyInArrow(build, layout), "lm-trie")

    def frequent_pairs(batches):
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k.as_buffer(), np.int64)), pa.array(np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64))], names=["key", "value"])

    often = _collect(tries.select("often", "often_codes").mapInArrow(frequent_pairs, "key long, value long"))
    model.pairs = Frequent(often.keys, often.values.astype(np.uint8))
    return model, words, tries.drop("often", "often_codes")


def _collect(rows: DataFrame) -> Frequent:
    """Frequent keys: at most 2 x FREQUENT rows, as each has its share of the tokens."""
    table = rows.toArrow()
    return Frequent(table["key"].to_numpy().view(np.uint64), table["value"].to_numpy())


_EMPTY = np.zeros(0, np.uint64)
_SCORED = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]


class _Scorer:
    """Scores what the task can resolve, and gathers queries for the shards."""

    def __init__(self, model: Model):
        self.m = model
        self.log_u = model.log_u(model.words.values)
        self.log_w = self.log_u + model.log_rest(model.words.values)
        self.uid = TaskContext.get().partitionId() << 36

    def run(self, batches):
        held, docs, tokens = [], 0, 0
        for batch, a, b, stream, doc in _streams(batches):
            i, known = self.m.words.find(stream)
            size = b - a
            base = np.bincount(doc[known], self.log_u[i[known]], size)
            score = np.bincount(doc[known], self.log_w[i[known]], size)
            n_known = np.bincount(doc[known], minlength=size)
            pairs = _pairs(stream)
            j, often = self.m.pairs.find(pairs)
            score += np.bincount(doc[often], self.m.pairs.values[j[often]] / STEP, size)
            head = (batch.column(0).slice(a, size), batch.column(2).slice(a, size), np.bincount(doc, minlength=size), n_known, base, score)
            if docs and docs + size > _MAX_DOCS:
                yield from self.flush(held, docs)
                held, docs, tokens = [], 0, 0
            held.append((head, stream[~known], doc[~known] + docs, pairs[~often], doc[~often] + docs))
            docs, tokens = docs + size, tokens + len(stream)
            if tokens > FLUSH_TOKENS:
                yield from self.flush(held, docs)
                held, docs, tokens = [], 0, 0
        if held:
            yield from self.flush(held, docs)

    def flush(self, held, docs):
        start, self.uid = self.uid, self.uid + docs
        heads = [h[0] for h in held]
        columns = [pa.concat_arrays([pa.array(h[k]) for h in heads]) for k in range(6)]
        sent: dict[int, list[bytes]] = {}
        for at, keys, doc, shard in self.queries(held):
            for s, i in _by_shard(shard, self.m.shards):
                i = i[np.argsort(keys[i], kind="stable")]
                row = sent.setdefault(s, [encode(_EMPTY), b"", encode(_EMPTY), b""])
                row[at], row[at + 1] = encode(keys[i]), doc[i].astype("<u4" if docs > _MAX_DOCS else "<u2").tobytes()
        rows = [{"shard": s, "uid": start, "docs": docs, "words": r[0], "word_docs": r[1], "pairs": r[2], "pair_docs": r[3]} for s, r in sorted(sent.items())]
        # the documents themselves travel with any shard's message
        home = _home(start, self.m.shards)
        whole = {"shard": home, "uid": start, "docs": docs, "heads": [{k: v for k, v in zip(_SCORED, row)} for row in zip(*(c.to_pylist() for c in columns))]}
        yield pa.RecordBatch.from_pylist([*rows, whole], schema=_QUERY)

    def queries(self, held):
        words, doc = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        yield 0, words, doc, _word_shard(words >> np.uint64(32), self.m.shards)
        pairs, doc = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        yield 2, pairs, doc, self.m.pair_shard(pairs)


def _home(start: int, shards: int) -> int:
    """The shard whose message carries the documents from uid ``start`` on.
    Uids of all tasks share their low bits, so they are hashed."""
    return zlib.crc32(int(start).to_bytes(8, "little")) % shards


_HEADS = pa.list_(pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]))
_QUERY = pa.schema([("shard", pa.int32()), ("uid", pa.int64()), ("docs", pa.int64()), ("words", pa.binary()), ("word_docs", pa.binary()), ("pairs", pa.binary()), ("pair_docs", pa.binary()), ("heads", _HEADS)])
_QUERY_SQL = "shard int, uid long, docs long, words binary, word_docs binary, pairs binary, pair_docs binary, heads array<struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>>"
_PART = pa.schema([("uid", pa.int64()), ("known", pa.binary()), ("base", pa.binary()), ("score", pa.binary()), ("heads", _HEADS)])
_PART_SQL = "uid long, known binary, base binary, score binary, heads array<struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>>"
_SCORED_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _answer(model: Model):
    def run(key, queries, shard):
        """For each message what the shard knows about its documents: one row."""
        count, keys, trie = np.zeros(0, np.int64), None, None
        for row in shard.to_batches() if shard.num_rows else ():
            for i in range(row.num_rows):
                if row.column("keys")[i].is_valid:
                    keys = Sequence(row.column("keys")[i].as_buffer())
                    count = np.frombuffer(row.column("counts")[i].as_buffer(), "<i8")
                if row.column("codes")[i].is_valid:
                    trie = Trie(*[row.column(k)[i].as_buffer() for k in ("contexts", "pointers", "successors", "codes")])
        out = []
        for batch in queries.to_batches():
            for i in range(batch.num_rows):
                uid, docs = batch.column("uid")[i].as_py(), batch.column("docs")[i].as_py()
                if batch.column("heads")[i].is_valid:
                    out.append({"uid": uid, "heads": batch.column("heads")[i].as_py()})
                    continue
                kind = "<u4" if docs > _MAX_DOCS else "<u2"
                q, doc = Sequence(batch.column("words")[i].as_buffer()).values(), np.frombuffer(batch.column("word_docs")[i].as_buffer(), kind)
                c = np.zeros(len(q))
                if keys is not None:
                    at, found = keys.successor(q)
                    c[found] = count[at[found]]
                base = np.bincount(doc, model.log_u(c), docs)
                score = base + np.bincount(doc, model.log_rest(c), docs)
                known = np.bincount(doc[c > 0], minlength=docs)
                q, doc = Sequence(batch.column("pairs")[i].as_buffer()).values(), np.frombuffer(batch.column("pair_docs")[i].as_buffer(), kind)
                if trie is not None:
                    score += np.bincount(doc, trie.lookup(q) / STEP, docs)
                out.append({"uid": uid, "known": known.astype("<u4").tobytes(), "base": base.tobytes(), "score": score.tobytes()})
        return pa.Table.from_pylist(out, schema=_PART)

    return run


def _sum(key, parts):
    """All rows of one message's documents -> one row a document."""
    heads = parts["heads"].combine_chunks().drop_null().values
    out = {k: heads.field(k) for k in ("doc_id", "held_out", "n_tokens")}
    sums = {k: heads.field(f).to_numpy().copy() for k, f in (("known", "n_known"), ("base", "base"), ("score", "score"))}
    for k, kind in (("known", "<u4"), ("base", "<f8"), ("score", "<f8")):
        for x in parts[k]:
            if x.is_valid:
                sums[k] += np.frombuffer(x.as_buffer(), kind).astype(sums[k].dtype)
    return pa.table(out | {"n_known": sums["known"], "base_score": sums["base"], "score": sums["score"]})


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mu: float = MU, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (remainder == 1).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(8, -(-size // (6 * shard_tokens)))
    model, words, tries = _train(rows.filter(~F.col("held_out")).select("doc_id", "text"), mu, shards)

    def send(batches):
        yield from _Scorer(model).run(batches)

    none = F.lit(None).cast("binary")
    levels = ("contexts", "pointers", "successors", "codes")
    known = words.select("shard", "keys", "counts", *[none.alias(k) for k in levels]).unionByName(tries.select("shard", none.alias("keys"), none.alias("counts"), *levels))
    parts = rows.mapInArrow(send, _QUERY_SQL).groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_answer(model), _PART_SQL)
    sums = parts.groupBy("uid").applyInArrow(_sum, _SCORED_SQL)
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
