"""A hidden Markov language model: Baum-Welch over all training texts, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, in_fold, removed, scratch, shuffles_removed, stored

#: Bytes of text that share a vocabulary, tokens that are worked on together, and words of a bucket, repeats in blocks included.
BLOCK, SLICE, BUCKET = 16 << 20, 250_000, 400_000
#: The latent states, and the rounds of Baum-Welch.
STATES, ROUNDS = 6, 4
#: Weight of the corpus-wide distribution in each state's, and of an even spread in each row of transitions, in tokens.
PRIOR, EVEN = 1000.0, 10.0
#: How far the first emissions stand off the corpus-wide distribution, in logarithms.
SPREAD = 0.7
#: Steps of the forward recursion between two scalings; a double holds the product of as many emissions.
STEPS = 8
END = b""

BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())), ("lengths", pa.binary()), ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("hashes", pa.binary()), ("counts", pa.binary())])
BLOCKS_SQL = "block long, doc_id array<long>, learn array<boolean>, lengths binary, tokens binary, words array<binary>, hashes binary, counts binary"


def packed(tokens: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(tokens.astype(np.int32).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32)


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Tokens in each text, all tokens by number, and the words of the numbers; the end is number 0."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).fill_null(b"").view(pa.string())))
    of = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    coded = pa.concat_arrays([pa.array([END.decode()]), parts.flatten()]).dictionary_encode()
    tokens = coded.indices.to_numpy()[1:]
    full = np.flatnonzero(tokens)  # white space at a text's edges gives empty parts
    lengths = np.bincount(of[full], minlength=len(texts)) + 1
    placed = np.zeros(lengths.sum(), np.int32)
    placed[np.arange(len(full)) + of[full]] = tokens[full]
    return lengths, placed, coded.dictionary.view(pa.binary())


def whole(values: pa.Array) -> pa.Array:
    """The values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def filled(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows in lots of so many bytes of text, the third column; the row that reaches them ends a lot."""
    rows, left = [], size
    for b in batches:
        grown, at = np.cumsum(pc.binary_length(b.column(2)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < b.num_rows:
            before = int(grown[at - 1]) if at else 0
            upto = min(b.num_rows, int(np.searchsorted(grown, before + left)) + 1)
            rows.append(b.slice(at, upto - at))
            left, at = left - int(grown[upto - 1]) + before, upto
            if left <= 0:
                yield rows
                rows, left = [], size
    if rows:
        yield rows


def encode(docs: DataFrame, learn: Column) -> DataFrame:
    """Blocks of documents whose words are numbered within the block, by a hash; a text's tokens are its words and one end.

    Words are what ASCII white space parts, A-Z in lower case. A null text is empty. `counts` are of documents that
    learn holds for.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, rows in enumerate(filled(batches, BLOCK)):
            ids, ok, texts = (pa.concat_arrays(c) for c in zip(*[r.columns for r in rows]))
            lengths, tokens, words = numbered(texts)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))
            order = np.argsort(hashes, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            tokens = rank[tokens]
            counts = np.bincount(tokens[np.repeat(ok.to_numpy(zero_copy_only=False), lengths)], minlength=len(words))
            yield batch(
                BLOCKS, block=[part << 32 | number], doc_id=whole(ids.cast(pa.int64())), learn=whole(ok), lengths=[lengths.astype(np.int32).tobytes()], tokens=[packed(tokens)],
                words=whole(words.take(pa.array(order))), hashes=[hashes[order].tobytes()], counts=[counts.tobytes()],
            )

    return docs.select("doc_id", learn.alias("_learn"), F.col("text").cast("binary").alias("_text")).mapInArrow(run, BLOCKS_SQL)


MEMBERS = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("ids", pa.binary()), ("n", pa.binary()), ("stats", pa.list_(pa.float64()))])
MEMBERS_SQL = "kind int, bucket long, block long, first long, ids binary, n binary, stats array<double>"
TABLE, MEMBER = 0, 1


def first_shares(hashes: np.ndarray, n: np.ndarray, states: int) -> np.ndarray:
    """Training counts put a little off by state and word, each its own way, by the word's hash."""
    odd = np.random.default_rng(5).integers(0, 1 << 63, states, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    even = ((hashes[:, None] * odd) >> np.uint64(40)).astype(np.float64) / (1 << 24) - 0.5
    return n[:, None] * np.exp(SPREAD * np.sqrt(12) * even)


def vocabulary(blocks: DataFrame, states: int = STATES, per_bucket: int = BUCKET) -> DataFrame:
    """The words of all blocks, dealt to buckets by their hash.

    Rows of kind MEMBER hold the numbers in the bucket of a block's words from the first one on (ids); rows of kind
    TABLE the hashes (ids) and training counts (n) of all of a bucket's words, and in stats the tokens, the different
    words, those that occur once, and each state's sum of the first emissions.
    """
    bits = max(0, int(blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]) // per_bucket).bit_length()
    dealt = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.binary())), ("hashes", pa.binary()), ("counts", pa.binary())])

    def deal(batches):
        for b in batches:
            for block, words, hashes, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                words, hashes, counts = words.values, np.frombuffer(hashes.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64)
                bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                edge = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                some = list(zip(edge, edge[1:]))
                yield batch(dealt, bucket=bucket[edge[:-1]], block=[block] * len(some), first=edge[:-1], words=pa.ListArray.from_arrays(pa.array(edge, pa.int32()), words), hashes=[hashes[s:e].tobytes() for s, e in some], counts=[counts[s:e].tobytes() for s, e in some])

    def meet(rows: pa.Table) -> pa.Table:
        words = rows.column("words").combine_chunks()
        coded = words.flatten().dictionary_encode()
        every, known = coded.indices.to_numpy(), len(coded.dictionary)
        ids = np.split(every, np.cumsum(pc.list_value_length(words).to_numpy())[:-1])
        n = np.bincount(every, weights=np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts")]), minlength=known).astype(np.int64)
        hashes = np.empty(known, np.uint64)
        hashes[every] = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("hashes")])
        stats = [float(n.sum()), float((n > 0).sum()), float((n == 1).sum()), *first_shares(hashes, n, states).sum(0).tolist()]
        bucket = rows.column("bucket")[0].as_py()
        return pa.Table.from_batches([
            batch(MEMBERS, kind=[TABLE], bucket=[bucket], block=[-1], first=[0], ids=[hashes.tobytes()], n=[n.tobytes()], stats=[stats]),
            batch(MEMBERS, kind=[MEMBER] * len(ids), bucket=[bucket] * len(ids), block=rows.column("block").combine_chunks(), first=rows.column("first").combine_chunks(), ids=[x.tobytes() for x in ids], n=[None] * len(ids), stats=[None] * len(ids)),
        ])

    given = blocks.select("block", "words", "hashes", "counts").mapInArrow(deal, "bucket long, block long, first long, words array<binary>, hashes binary, counts binary")
    return given.groupBy("bucket").applyInArrow(meet, MEMBERS_SQL)


@dataclass(frozen=True)
class Model:
    """What does not grow with the vocabulary: start and moves are probabilities; n, v: training tokens, known words."""

    start: np.ndarray
    moves: np.ndarray
    n: int
    v: int
    unknown: float


@dataclass(frozen=True)
class Layout:
    """Documents, longest first, with their tokens by time: the tokens at a time are those of the first documents."""

    at: np.ndarray
    offsets: np.ndarray


def layout(lengths: np.ndarray) -> Layout:
    """For lengths that don't rise: each token's place, and where the places of each time begin."""
    alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] if len(lengths) else 0), side="right")
    offsets = np.concatenate([[0], np.cumsum(alive)])
    time = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rank = np.repeat(np.arange(len(lengths)), lengths)
    return Layout(offsets[time] + rank, offsets)


def before(offsets: np.ndarray) -> np.ndarray:
    """The places of the tokens before, for the places of all times but the first."""
    alive = np.diff(offsets)
    return np.arange(offsets[1], offsets[-1]) - np.repeat(alive[:-1], alive[1:])


def forward(model: Model, emitted: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and the scales: a text's likelihood is the product of its tokens' scales.

    Within the recursion they are scaled once in STEPS times; what that leaves out is made up for all tokens together.
    """
    alpha, total, every = np.empty_like(emitted), np.empty(len(emitted)), np.ones(len(model.start))
    edges, scaled = offsets.tolist(), np.zeros(len(emitted), bool)
    np.multiply(model.start, emitted[: edges[1]], out=alpha[: edges[1]])
    for k, (p, s, e) in enumerate(zip(edges, edges[1:], edges[2:]), 1):
        if k % STEPS == 0:
            total[p:s] = alpha[p:s] @ every
            alpha[p:s] /= total[p:s, None]
            scaled[p:s] = True
        a = alpha[s:e]
        np.dot(alpha[p : p + e - s], model.moves, out=a)
        a *= emitted[s:e]
    left = alpha @ every
    alpha /= left[:, None]
    scale = np.where(scaled, total, left)
    scale[edges[1] :] /= np.where(scaled, 1.0, left)[before(offsets)]
    return alpha, scale


def backward(model: Model, emitted: np.ndarray, scale: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled backward probabilities, and for all tokens but a text's first the scaled emissions times these."""
    beta, weighted = np.ones_like(emitted), emitted / scale[:, None]
    steps = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    back = np.ascontiguousarray(model.moves.T)
    for (s, _), (t, u) in zip(steps[-2::-1], steps[:0:-1]):
        w = weighted[t:u]
        w *= beta[t:u]
        np.dot(w, back, out=beta[s : s + u - t])
    return beta, weighted


def slices(lengths: np.ndarray):
    """Documents of like length, longest first, in lots of a bounded number of tokens (or one document)."""
    order = np.argsort(-lengths, kind="stable")
    total = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, side="right")))
        yield order[at:upto]
        at = upto


def gathered(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The tokens of these documents, one document after the other."""
    first = np.cumsum(lengths) - lengths
    return tokens[np.arange(lengths.sum()) - np.repeat(first - starts, lengths)]


EMITTED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("emit", pa.binary()), ("n", pa.binary())])
EMITTED_SQL = "bucket long, block long, first long, emit binary, n binary"


def table_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table, list[np.ndarray]]:
    """Hashes and counts of a bucket's words, the rows of the blocks' words, and their numbers in the bucket."""
    kind = np.array(rows.column("kind"))
    whole, own = rows.filter(pa.array(kind == TABLE)), rows.filter(pa.array(kind == MEMBER))
    return np.frombuffer(whole.column("ids")[0].as_py(), np.uint64), np.frombuffer(whole.column("n")[0].as_py(), np.int64), own, [np.frombuffer(x.as_py(), np.int32) for x in own.column("ids")]


def dealt_out(own: pa.Table, ids: list[np.ndarray], emit: np.ndarray, n: np.ndarray | None) -> pa.Table:
    """(bucket, block, first, emit, n): the emissions of each block's words in each state, and their training counts."""
    emit = emit.astype(np.float32)
    return pa.Table.from_batches([batch(EMITTED, **{c: own.column(c).combine_chunks() for c in ("bucket", "block", "first")}, emit=[emit[x].tobytes() for x in ids], n=[None if n is None else n[x].tobytes() for x in ids])])


def first_emissions(members: DataFrame, sums: np.ndarray, last: bool = False) -> DataFrame:
    """The emissions that training begins with; sums: each state's over all words. Only the last ones come with counts."""

    def made(rows: pa.Table) -> pa.Table:
        hashes, n, own, ids = table_of(rows)
        return dealt_out(own, ids, first_shares(hashes, n, len(sums)) / sums, n if last else None)

    return members.groupBy("bucket").applyInArrow(made, EMITTED_SQL)


def next_emissions(members: DataFrame, counted: DataFrame, totals: np.ndarray, n_all: int, last: bool = False) -> DataFrame:
    """Emissions from the expected counts of all blocks, summed by word; totals: each state's expected tokens."""

    def made(rows: pa.Table, told: pa.Table) -> pa.Table:
        _, n, own, ids = table_of(rows)
        of = dict(zip(zip(own.column("block").to_pylist(), own.column("first").to_pylist()), ids))
        total = PRIOR * np.repeat(n[:, None] / n_all, len(totals), axis=1)
        for block, first, blob in zip(told.column("block").to_pylist(), told.column("first").to_pylist(), told.column("blob")):
            total[of[block, first]] += np.frombuffer(blob.as_py(), np.float32).reshape(-1, len(totals))  # a block's words are different
        return dealt_out(own, ids, total / (totals + PRIOR), n if last else None)

    told = counted.where("block >= 0").select(F.col("bucket").alias("_bucket"), "block", "first", "blob")
    return members.groupBy("bucket").cogroup(told.groupBy("_bucket")).applyInArrow(made, EMITTED_SQL)


def emitted_of(told: pa.Table, words: int, states: int) -> np.ndarray:
    """The emissions of a block's words."""
    emit = np.ones((words, states))
    for first, some in zip(told.column("first").to_pylist(), told.column("emit")):
        some = np.frombuffer(some.as_py(), np.float32).reshape(-1, states)
        emit[first : first + len(some)] = some
    return emit


EXPECTED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.float64()))])
EXPECTED_SQL = "bucket long, block long, first long, blob binary, stats array<double>"


def expected(blocks: DataFrame, emitted: DataFrame, model: Model) -> DataFrame:
    """One pass of Baum-Welch over all texts that are learned from.

    A row for each bucket and block with the expected emissions (blob) of the block's words by state, and one of bucket
    -1 for each block with its log likelihood (log10), expected starts, moves and tokens of each state.
    """
    states = len(model.start)

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for r in block.to_pylist():
            lengths, tokens = np.frombuffer(r["lengths"], np.int32).astype(np.int64), unpacked(r["tokens"])
            starts, keep = np.cumsum(lengths) - lengths, np.flatnonzero(r["learn"])
            emit = emitted_of(told, int(tokens.max()) + 1, states)
            start, moves, table, total = np.zeros(states), np.zeros((states, states)), np.zeros((len(emit), states)), 0.0
            for some in slices(lengths[keep]):
                some = keep[some]
                lay = layout(lengths[some])
                by_time = np.empty(len(lay.at), np.int64)
                by_time[lay.at] = gathered(tokens, starts[some], lengths[some])
                given = np.take(emit, by_time, axis=0)
                alpha, scale = forward(model, given, lay.offsets)
                beta, weighted = backward(model, given, scale, lay.offsets)
                total += float(np.log10(scale).sum())
                first = lay.offsets[1]
                moves += model.moves * (np.take(alpha, before(lay.offsets), axis=0).T @ weighted[first:])
                alpha *= beta
                start += alpha[:first].sum(0)
                for k in range(states):
                    table[:, k] += np.bincount(by_time, weights=alpha[:, k], minlength=len(table))
            edge = [*told.column("first").to_pylist()]
            ends = [f + len(x.as_py()) // (4 * states) for f, x in zip(edge, told.column("emit"))]
            blobs = [table[s:e].astype(np.float32).tobytes() for s, e in zip(edge, ends)]
            out.append(batch(EXPECTED, bucket=told.column("bucket").combine_chunks(), block=[r["block"]] * len(edge), first=edge, blob=blobs, stats=[None] * len(edge)))
            out.append(batch(EXPECTED, bucket=[-1], block=[-1], first=[0], blob=[None], stats=[[total, *start, *moves.ravel(), *table.sum(0)]]))
        return pa.Table.from_batches(out, EXPECTED)

    return blocks.select("block", "learn", "lengths", "tokens").groupBy("block").cogroup(emitted.select("bucket", F.col("block").alias("_block"), "first", "emit").groupBy("_block")).applyInArrow(run, EXPECTED_SQL)


def summed(found: DataFrame, width: int) -> np.ndarray:
    """The sums of the first elements of the stats of all rows."""
    row = found.where("stats is not null").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0.0)) for k in range(width)]).first()
    return np.array(row, dtype=np.float64)


def first_model(members: DataFrame, states: int = STATES) -> tuple[Model, np.ndarray]:
    """Start, moves and the unknown's probability before training, and each state's sum of the first emissions."""
    n, v, once, *sums = summed(members, 3 + states)
    moves = np.full((states, states), 0.1 / max(1, states - 1)) + (0.9 - 0.1 / max(1, states - 1)) * np.eye(states)
    unknown = min(0.5, max(once / n, 0.5 / (n + 0.5 * (v + 1)))) if n else 1.0
    return Model(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), int(n), int(v), unknown), np.array(sums)


def train(blocks: DataFrame, members: DataFrame, rounds: int = ROUNDS, states: int = STATES) -> tuple[Model, DataFrame, list[float]]:
    """The model, the emissions of each block's words, and the log likelihood (log10) before each round."""
    model, sums = first_model(members, states)
    likelihoods = []
    rounds = rounds if model.n else 0
    emitted = stored(first_emissions(members, np.maximum(sums, 1e-300), last=not rounds), "emitted")
    for k in range(rounds):
        counted = stored(expected(blocks, emitted, model), "expected")
        total, *rest = summed(counted, 1 + states + states * states + states)
        likelihoods.append(total)
        rest = np.array(rest)
        start, moves, totals = rest[:states] + EVEN / states, rest[states:-states].reshape(states, states) + EVEN / states, rest[-states:]
        model = replace(model, start=start / start.sum(), moves=moves / moves.sum(1, keepdims=True))
        removed(emitted)
        emitted = stored(next_emissions(members, counted, totals, model.n, last=k == rounds - 1), "emitted")
        removed(counted)
    return model, emitted, likelihoods


SCORES = pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(blocks: DataFrame, emitted: DataFrame, model: Model) -> DataFrame:
    """doc_id, learn, n_tokens, n_known, base_score, score (log10) of every text.

    A known word's probability in a state is its emission there. All unknown words are one further outcome, of the same
    probability in each state: the share of words seen once, by Good and Turing; the known ones share the rest. So each
    state's probabilities add up to 1 over the known words and the unknown one.
    """
    states = len(model.start)

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for r in block.to_pylist():
            lengths, tokens = np.frombuffer(r["lengths"], np.int32).astype(np.int64), unpacked(r["tokens"])
            starts = np.cumsum(lengths) - lengths
            emit, seen = emitted_of(told, int(tokens.max()) + 1, states), np.zeros(int(tokens.max()) + 1, np.int64)
            for first, n in zip(told.column("first").to_pylist(), told.column("n")):
                n = np.frombuffer(n.as_py(), np.int64)
                seen[first : first + len(n)] = n
            base_of = np.log10((seen + 0.5) / (model.n + 0.5 * (model.v + 1)))
            emit = np.where(seen[:, None] > 0, (1 - model.unknown) * emit, model.unknown)
            result = np.zeros(len(lengths))
            for some in slices(lengths):
                lay = layout(lengths[some])
                by_time = np.empty(len(lay.at), np.int64)
                by_time[lay.at] = gathered(tokens, starts[some], lengths[some])
                logs = np.log10(forward(model, np.take(emit, by_time, axis=0), lay.offsets)[1])[lay.at]
                result[some] = np.add.reduceat(logs, np.cumsum(lengths[some]) - lengths[some])
            known = np.add.reduceat((seen > 0)[tokens].astype(np.int64), starts)
            base = np.add.reduceat(base_of[tokens], starts)
            out.append(batch(SCORES, doc_id=r["doc_id"], learn=r["learn"], n_tokens=lengths, n_known=known, base_score=base, score=result))
        return pa.Table.from_batches(out, SCORES)

    return blocks.select("block", "doc_id", "learn", "lengths", "tokens").groupBy("block").cogroup(emitted.select(F.col("block").alias("_block"), "first", "emit", "n").groupBy("_block")).applyInArrow(run, "doc_id long, learn boolean, n_tokens long, n_known long, base_score double, score double")


def op1_hmm(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of doc_id leaves 1 by 5 are held out; a null doc_id is learned from. Null texts are empty and
    have the end as their one token; repeated rows count each, so ties need no rule; a text of any length is scored
    whole. An empty table gives an empty result; with nothing to learn from, the one unknown outcome is certain and all
    scores are 0. Other columns are not looked at.

    Every word has emissions of its own. They live in a table of buckets of words; in each round blocks of texts get
    their words' emissions from the buckets and give them the expected counts, both as arrays.
    """
    held_out = in_fold("doc_id", 5, 1)
    with shuffles_removed(docs.sparkSession), scratch() as keep:
        blocks = keep(stored(encode(docs, ~held_out), "blocks"))
        members = stored(vocabulary(blocks), "members")
        model, emitted, _ = train(blocks, members)
        keep(emitted)
    found = score(blocks, emitted, model)
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
