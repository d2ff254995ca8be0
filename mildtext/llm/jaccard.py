"""Exact Jaccard join of word shingles through a token-group matrix.

1. A prefix of each document's rarest shingles: documents that are similar enough share
   several, more the longer they are.  Rarity comes from a counting sketch of fixed size over
   all documents; any order gives the right result, a good one keeps the lists short.
   Tasks exchange packed tokens, without names, and learn how many of a document's prefix
   occur elsewhere; documents with too few for any similar one leave here, so that shingles
   which meet by chance, more of them in a larger corpus, make no lists.
2. Documents that share one are put into small groups by their smallest digest, so that
   similar ones meet.  A group is one row: the union of its members' shingles, as counts by
   a part of the digest, and the members' texts, packed together.
3. Groups that share enough prefix shingles are candidates.  The overlap of the unions bounds
   every overlap of members, so only pairs of groups whose bound suffices are opened: the
   texts are fetched, become a matrix of members and shingles, and one matrix product gives
   all overlaps exactly.
4. Components need only enough links to hold together: first every group meets two pivot groups of
   each list, then those groups meet whose members are still apart.

Documents with equal sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mildtext.llm import wordhash
from mildtext.llm.common import opened as unpacked
from mildtext.llm.common import dropped, lean, sliced, squeezed, written
from mildtext.llm.components import components
from mildtext.session import SHARED_BYTES, measured_bytes, sized, small_batches


@dataclass(frozen=True)
class Join:
    """``words`` per shingle; ``percent``, the least similarity; ``members`` of a group, and ``shingles`` of
    all of them beyond which it takes no more; ``sketch`` counters, 2 to its power (a byte each on the driver and
    in a worker; too few for the corpus only make lists longer); ``rounds`` with pivots before all groups of a list
    meet; one more shared shingle is asked for per ``step`` shingles of a set; ``tokens`` of a batch of the exchange."""

    words: int = 5
    percent: int = 80
    members: int = 64
    shingles: int = 200_000
    sketch: int = 24
    rounds: int = 2
    step: int = 16
    tokens: int = 1 << 20


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _needed(n: np.ndarray | int, percent: int):
    """Least overlap that a set of ``n`` needs with any similar set."""
    return -(-(n * percent) // 100)


def _asked(n: np.ndarray | int, how: Join):
    """Shingles that the prefixes of two similar sets share at least, ``n`` being the size of the smaller one."""
    return np.minimum(1 + n // how.step, _needed(n, how.percent))


def _bounds(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def rarity(docs: DataFrame, how: Join) -> np.ndarray:
    """Levels of how often shingles of each slot of the sketch occur, over all documents.

    Every task counts its own documents; the counts of 64 parts are added up in Spark, and
    2 ** ``sketch`` bytes come to the driver, whatever the size of the corpus.
    """
    slots, parts = 1 << how.sketch, min(64, 1 << how.sketch)
    shift = np.uint64(64 - how.sketch)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in sliced(batches):
            for _, texts in wordhash.in_slices([wordhash.normal(t, True) for t in batch.column(0).to_pylist()]):
                digests, _ = wordhash.shingle_sets(wordhash.Words(texts), how.words)
                slot, n = np.unique((digests >> shift).astype(np.int64), return_counts=True)
                total[slot] += n.astype(np.uint32)
        for part, own in enumerate(np.split(total, parts)):
            width = np.min_scalar_type(own.max())  # as narrow as the task's counts are
            counts = zstandard.compress(own.astype(width.newbyteorder("<")).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts])], ["part", "counts"])

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*[c.to_pylist() for c in batch.columns]):
                own = totals.setdefault(part, np.zeros(slots // parts, np.int64))
                raw = zstandard.decompress(counts)
                own += np.frombuffer(raw, f"<u{len(raw) // len(own)}")
        if totals:
            levels = [np.minimum(255, 8 * np.log2(1 + own)).astype(np.uint8).tobytes() for own in totals.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(levels)], ["part", "levels"])

    counted = docs.select("text").mapInArrow(count, "part int, counts binary").repartition(parts, "part")
    found = dict(counted.mapInArrow(add, "part int, levels binary").collect())
    empty = bytes(slots // parts)
    return np.frombuffer(b"".join(found.get(p, empty) for p in range(parts)), np.uint8)


def _set_names(digests: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, digest and first place of the set of each text."""
    n = np.bincount(owner, minlength=texts)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    some = np.flatnonzero(n)
    names = np.zeros(texts, np.uint64)
    if len(some):
        names[some] = wordhash.mix(np.add.reduceat(wordhash.mix(digests, 1), first[some]), 2) + n[some].astype(np.uint64)
    return n, names, first


def sets(docs: DataFrame, levels: np.ndarray, how: Join) -> DataFrame:
    """``doc_id``, ``n`` (distinct shingles), ``set`` (digest of the set, null if empty), ``key`` (its smallest
    digest) and ``prefix`` (binary) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shift = np.uint64(64 - how.sketch)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_all, set_all, key_all, prefixes = [], [], [], []
            for _, texts in wordhash.in_slices([wordhash.normal(t, True) for t in batch.column(1).to_pylist()]):
                digests, owner = wordhash.shingle_sets(wordhash.Words(texts), how.words)
                n, names, first = _set_names(digests, owner, len(texts))
                some = np.flatnonzero(n)
                keys = np.zeros(len(texts), np.uint64)
                if len(some):
                    keys[some] = np.minimum.reduceat(wordhash.mix(digests, 3), first[some])
                order = np.lexsort((digests, levels[(digests >> shift).astype(np.int64)], owner))
                length = n - _needed(n, how.percent) + _asked(n, how)
                front = np.arange(len(digests)) - first[owner] < length[owner]
                chosen, whose = digests[order][front], owner[front]
                at = _bounds(whose, len(texts)).tolist()
                raw = chosen.astype("<u8").tobytes()
                prefixes += [raw[8 * a : 8 * b] for a, b in zip(at, at[1:])]
                n_all.append(n)
                set_all.append(names)
                key_all.append(keys)
            if not n_all:
                continue
            n = np.concatenate(n_all)
            none = pa.array(n == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pc.if_else(none, pa.scalar(None, pa.int64()), _i64(np.concatenate(set_all))),
                    _i64(np.concatenate(key_all)),
                    pa.array(prefixes, pa.binary()),
                ],
                ["doc_id", "n", "set", "key", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, set bigint, key bigint, prefix binary")


# Bits of a token in the exchange.  Tokens that meet by chance count as shared, so none is lost by it.
_PACKED = 40
_MESSAGES = pa.schema([("batch", pa.int64()), ("owner", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_ANSWERS = pa.schema([("batch", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())])


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first, compressed: the upper ones are nearly equal."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T[:5]).tobytes()


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(5, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def alive(described: DataFrame, how: Join) -> DataFrame:
    """``set`` of the rows (``set``, ``n``, ``prefix``) that share enough of their prefix to be similar to another row.

    A batch of rows sends each owner, a range of tokens, its sorted tokens as gaps and row numbers; the owner
    answers how many of each row's tokens came more than once.  A token that several rows of a batch have goes
    once and for no row, so neither copies nor frequent shingles gather at an owner.
    """
    total = described.agg(F.sum(F.length("prefix"))).first()[0] or 0
    owners = max(8, -(-total // (8 * how.tokens)))
    bounds = np.array([(i << _PACKED) // owners for i in range(owners + 1)], np.uint64)
    alone = np.uint64((1 << _PACKED) - 1)  # in place of a row's number: the batch has counted its rows

    def pack(names: list[int], sizes: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        n = np.array(sizes, np.int64)
        tokens = np.frombuffer(b"".join(blobs), "<u8") >> np.uint64(64 - _PACKED)
        row = np.repeat(np.arange(len(names), dtype=np.uint64), [len(b) // 8 for b in blobs])
        order = np.argsort(tokens)
        tokens, row = tokens[order], row[order]
        new = np.ones(len(tokens), bool)
        new[1:] = tokens[1:] != tokens[:-1]
        runs = np.diff(np.append(np.flatnonzero(new), len(tokens)))
        several = np.repeat(runs > 1, runs)
        counts = np.bincount(row[several].astype(np.int64), minlength=len(names))
        row[several] = alone
        tokens, row = tokens[new], row[new]
        own = np.array(names, np.int64)
        asked = np.maximum(1, _asked(_needed(n, how.percent), how))
        batch = int(wordhash.mix(wordhash.mix(own.view(np.uint64), 4) + np.arange(len(own), dtype=np.uint64)).sum().view(np.int64))
        out = [(batch, batch % owners, -1, np.concatenate([own, asked, counts]).astype("<i8").tobytes())]
        at = np.searchsorted(tokens, bounds).tolist()
        for owner, (a, b) in enumerate(zip(at, at[1:])):
            if a < b:
                gaps = np.diff(tokens[a:b], prepend=bounds[owner])
                out.append((batch, owner, b - a, zstandard.compress(_planes(gaps) + _planes(row[a:b]), 1)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _MESSAGES)], schema=_MESSAGES)

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, blobs, held = [], [], [], 0
        for batch in sliced(batches):
            for name, n, blob in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                names.append(name)
                sizes.append(n)
                blobs.append(blob)
                held += len(blob)
                if held >= 8 * how.tokens:
                    yield pack(names, sizes, blobs)
                    names, sizes, blobs, held = [], [], [], 0
        if names:
            yield pack(names, sizes, blobs)

    def answer(messages: pa.Table) -> pa.Table:
        out, sent, froms, rows = [], [], [], []
        for batch, owner, n, data in zip(*[messages.column(c).to_pylist() for c in _MESSAGES.names]):
            if n < 0:
                out.append((batch, data, None))
                continue
            raw = zstandard.decompress(data)
            froms.append(batch)
            sent.append(np.cumsum(_unplaned(raw[: 5 * n], n)))
            rows.append(_unplaned(raw[5 * n :], n))
        if sent:
            tokens = np.concatenate(sent)
            order = np.argsort(tokens)
            ordered = tokens[order]
            again = np.zeros(len(tokens), bool)
            again[1:] = ordered[1:] == ordered[:-1]
            again[:-1] |= again[1:]
            twice = np.empty(len(tokens), bool)
            twice[order] = again
            at = 0
            for batch, row in zip(froms, rows):
                met = row[twice[at : at + len(row)]]
                at += len(row)
                met = met[met != alone].astype(np.int64)
                if len(met):
                    counts = np.bincount(met).astype("<u4").tobytes()
                    out.append((batch, None, zstandard.compress(counts, 1)))
        return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(_ANSWERS)], schema=_ANSWERS)

    def add(answers: pa.Table) -> pa.Table:
        # batches of the same rows have the same number; all their counts together are no fewer than each one's
        infos = [np.frombuffer(x, "<i8").reshape(3, -1) for x in answers.column("names").to_pylist() if x is not None]
        names, asked, total = infos[0][0], infos[0][1], sum(info[2] for info in infos)
        for counts in answers.column("counts").to_pylist():
            if counts is not None:
                own = np.frombuffer(zstandard.decompress(counts), "<u4")
                total[: len(own)] += own
        return pa.table({"set": pa.array(names[total >= asked])})

    sent = described.select("set", "n", "prefix").mapInArrow(send, "batch bigint, owner int, n int, data binary")
    answers = sent.groupBy("owner").applyInArrow(answer, "batch bigint, names binary, counts binary")
    return answers.groupBy("batch").applyInArrow(add, "set bigint")


def shared_prefixes(described: DataFrame) -> DataFrame:
    """``token`` and ``set`` of the prefix shingles that at least two different sets have."""

    @lean
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets of a task go once, so copies do not fill a list
        for batch in batches:
            names, blobs = [], []
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    blobs.append(blob)
            tokens = np.frombuffer(b"".join(blobs), "<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens), pa.array(np.repeat(np.array(names, np.int64), [len(b) // 8 for b in blobs]))], ["token", "set"]
            )

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted; the last of a batch waits for the next one, with what is known of its token
        last, met = np.empty((2, 0), np.int64), False
        for batch in batches:
            token, name = np.concatenate([last, [batch.column(0).to_numpy(), batch.column(1).to_numpy()]], axis=1)
            same = token[1:] == token[:-1]
            new = np.ones(len(token), bool)
            new[1:] = ~same | (name[1:] != name[:-1])
            token, name = token[new], name[new]
            same = token[1:] == token[:-1]
            twice = np.zeros(len(token), bool)
            twice[0] = met
            twice[1:] |= same
            twice[:-1] |= same
            last, met = np.array([token[-1:], name[-1:]]), bool(twice[-1])
            twice[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(token[twice]), pa.array(name[twice])], ["token", "set"])
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], ["token", "set"])

    rows = described.filter("set is not null").select("set", "prefix").mapInArrow(explode, "token bigint, set bigint")
    ordered = rows.repartition("token").sortWithinPartitions("token", "set")
    return ordered.mapInArrow(keep, "token bigint, set bigint")


GROUP = (
    "gid bigint, sets array<bigint>, least bigint, most bigint, slots binary, texts binary, links array<struct<a:bigint,b:bigint>>"
)
# Bits of a shingle's digest that stand for it in a union; the bound counts how often each value occurs.
_SLOT = np.dtype("<u2")


def _spanning(n: int, pairs: np.ndarray, known: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Links that, with the ``known`` ones, hold the same components together as all ``pairs`` do."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in known:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    out = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _similar(overlap: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    overlap = overlap.astype(np.int64)
    return (overlap > 0) & (100 * overlap >= percent * (n_a[:, None] + n_b[None, :] - overlap))


def _matrix(members: list[np.ndarray], union: np.ndarray) -> np.ndarray:
    """Which member has which shingle of the (sorted) union."""
    matrix = np.zeros((len(members), len(union)), np.float32)
    for row, own in enumerate(members):
        at = np.searchsorted(union, own)
        at[at == len(union)] = 0
        matrix[row, at[union[at] == own]] = 1
    return matrix


def groups(texts: DataFrame, how: Join) -> DataFrame:
    """Groups (:data:`GROUP`) of rows ``key``, ``set``, ``z`` (the text): of one key, at most ``members`` each.

    Rows are range-partitioned by key and set, so a key with most of the rows is cut over
    many tasks; sets that are equal are one member.  ``links`` are those inside the group.
    """

    def build(names: list[int], members: list[np.ndarray], own_texts: list[bytes]) -> tuple:
        union = np.unique(np.concatenate(members))
        links: list[dict] = []
        if len(members) > 1:
            sizes = np.array([len(m) for m in members])
            matrix = _matrix(members, union)
            pairs = np.argwhere(np.triu(_similar(matrix @ matrix.T, sizes, sizes, how.percent), 1))
            links = [{"a": names[a], "b": names[b]} for a, b in _spanning(len(names), pairs)]
        lengths = [len(m) for m in members]
        slots = (union >> np.uint64(48)).astype(_SLOT).tobytes()
        texts = zstandard.compress(b"\n".join(own_texts), 1)
        return names[0], list(names), min(lengths), max(lengths), slots, texts, links

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("gid", pa.int64()), ("sets", pa.list_(pa.int64())), ("least", pa.int64()), ("most", pa.int64()),
            ("slots", pa.binary()), ("texts", pa.binary()), ("links", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
        ])
        key, names, members, own_texts = None, [], [], []
        out: list[tuple] = []
        held = inside = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return batch

        for batch in sliced(batches, 100):
            keys, sets_, z = (batch.column(c).to_pylist() for c in range(3))
            for first, part in wordhash.in_slices([wordhash.normal(unpacked(t), True) for t in z]):
                digests, owner = wordhash.shingle_sets(wordhash.Words(part), how.words)
                _, given, _ = _set_names(digests, owner, len(part))
                given = given.view(np.int64).tolist()
                at = _bounds(owner, len(part)).tolist()
                for i in range(len(part)):
                    own_key, own_set = keys[first + i], sets_[first + i]
                    if given[i] != own_set:
                        continue  # another text under the same id, or none
                    if names and names[-1] == own_set and key == own_key:
                        continue
                    if names and (key != own_key or len(names) == how.members or inside >= how.shingles):
                        out.append(build(names, members, own_texts))
                        names, members, own_texts, inside = [], [], [], 0
                        held += len(out[-1][4]) + len(out[-1][5])
                    key = own_key
                    names.append(own_set)
                    members.append(digests[at[i] : at[i + 1]])
                    own_texts.append(part[i])
                    inside += at[i + 1] - at[i]
                    if held >= 4_000_000:
                        yield flush()
                        held = 0
        if names:
            out.append(build(names, members, own_texts))
        if out:
            yield flush()

    ordered = texts.select("key", "set", "z").repartitionByRange("key", "set").sortWithinPartitions("key", "set")
    return ordered.mapInArrow(run, GROUP)


def _sides(pairs: DataFrame, all_groups: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (``x``, ``y``; written) with some columns of both groups.

    Pairs are two numbers a row: where their measured size is small they go to the groups, so
    that only groups that are in a pair are shuffled, once per pair.
    """
    small = sized(pairs)
    both = None
    for side in "xy":
        own = all_groups.select(F.col("gid").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]).join(small, side)
        both = own if both is None else both.join(own, ["x", "y"])
    return both


def qualifying(pairs: DataFrame, all_groups: DataFrame, how: Join) -> DataFrame:
    """Pairs of groups (``x``, ``y``) whose unions overlap enough for two of their members to be similar.

    A value of a slot that both unions have stands for at most the lesser of its two counts.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            keep = []
            least = np.maximum(batch.column("least_x").to_numpy(), batch.column("least_y").to_numpy())
            for n, x, y in zip(least.tolist(), batch.column("slots_x").to_pylist(), batch.column("slots_y").to_pylist()):
                (u, n_u), (v, n_v) = (np.unique(np.frombuffer(s, _SLOT), return_counts=True) for s in (x, y))
                _, in_u, in_v = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                keep.append(int(np.minimum(n_u[in_u], n_v[in_v]).sum()) >= _needed(n, how.percent))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in "xy"], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, all_groups, ["least", "slots"]).mapInArrow(run, "x bigint, y bigint")


def opened(pairs: DataFrame, all_groups: DataFrame, how: Join) -> DataFrame:
    """Links (``a``, ``b``: sets) between members of the pairs of groups (``x``, ``y``)."""

    def members(texts: bytes) -> list[np.ndarray]:
        part = zstandard.decompress(texts).split(b"\n")
        digests, owner = wordhash.shingle_sets(wordhash.Words(part), how.words)
        at = _bounds(owner, len(part)).tolist()
        return [digests[a:b] for a, b in zip(at, at[1:])]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 20):
            out: list[tuple[int, int]] = []
            rows = zip(*[batch.column(f"{c}_{s}").to_pylist() for c in ("sets", "texts", "links") for s in "xy"])
            for sets_x, sets_y, texts_x, texts_y, links_x, links_y in rows:
                a, b = members(texts_x), members(texts_y)
                common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
                if not len(common):
                    continue
                n_a, n_b = (np.array([len(m) for m in side]) for side in (a, b))
                near = np.argwhere(_similar(_matrix(a, common) @ _matrix(b, common).T, n_a, n_b, how.percent))
                near[:, 1] += len(a)
                names = sets_x + sets_y
                place = {name: n for n, name in enumerate(names)}
                known = [(place[link["a"]], place[link["b"]]) for link in links_x + links_y]
                out += [(names[i], names[j]) for i, j in _spanning(len(names), near, known)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], ["a", "b"])

    enough = written(qualifying(pairs, all_groups, how))
    return _sides(enough, all_groups, ["sets", "texts", "links"]).mapInArrow(run, "a bigint, b bigint")


def join(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of non-blanks, A-Z lower-cased; a set holds the distinct shingles, or the whole
    sequence of fewer words.  Two rows link when 100 * overlap >= percent * union; the
    component is the smallest id reachable.  A null text, or one without words, has an
    empty set and links with nothing, so its component is its own id.  Repeated rows and equal texts link.
    A null id is a row without a name: its component is that of the rows it links with.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    prefixed = written(sets(docs, rarity(docs, how), how))
    described = written(prefixed.select("doc_id", "n", "set"))
    by_set = prefixed.filter("set is not null").groupBy("set")
    by_set = written(by_set.agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), F.count(F.lit(1)).alias("rows")))
    stands = by_set.select("set", "rep", "key")
    one_each = prefixed.filter("set is not null")
    copied = by_set.filter("rows > 1").select("set", "rep")
    if measured_bytes(copied) <= SHARED_BYTES:  # else copies go along: they count as shared, and lists tell them apart
        again = copied.select(F.col("set").alias("again"), "rep")
        of_copies = (F.col("set") == F.col("again")) & ~F.col("doc_id").eqNullSafe(F.col("rep"))
        one_each = one_each.join(F.broadcast(again), of_copies, "left_anti")
    some = written(alive(one_each, how).distinct())
    shared = written(shared_prefixes(one_each.join(sized(some), "set", "left_semi")))
    dropped(prefixed, some)
    stands = written(stands.join(shared.select("set").distinct(), "set"))
    small = squeezed(docs).withColumnRenamed("c0", "doc_id")
    texts = small.join(sized(stands), F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "set", "z")
    all_groups = written(groups(texts, how))
    member = written(all_groups.select("gid", "least", "most", F.explode("sets").alias("set")))
    lists = written(shared.join(sized(member), "set").select("token", "gid", "least", "most", F.col("set").alias("component")))
    dropped(shared, member)
    links = all_groups.select(F.explode("links").alias("l")).select("l.a", "l.b")
    # what two similar members of two groups share at least: _asked of the least size that the smaller can have
    needed = f"(greatest(least, o_least) * {how.percent} + 99) div 100"
    smaller = f"greatest({needed}, least(least, o_least))"
    asked = F.expr(f"least(1 + {smaller} div {how.step}, ({smaller} * {how.percent} + 99) div 100)")
    tested = found = None
    for turn in range(how.rounds + 1):
        # what is still apart in each list of groups that share a shingle
        if found is not None:
            old_lists = lists
            known = lists.join(sized(found), lists["component"] == found["node"], "left")
            lists = known.select("token", "gid", "least", "most", F.coalesce(found["component"], lists["component"]).alias("component"))
            lists = lists.repartition("token")
            ends = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
            # lists that hold together by now are done with
            torn = written(lists.distinct().join(ends.filter("low <> high").select("token"), "token", "left_semi"))
            dropped(old_lists)
            lists = torn
        # one row per list and group, however many components its members are in; a list stays in its task from here on
        apart = lists.repartition("token").groupBy("token", "gid").agg(
            F.first("least").alias("least"), F.first("most").alias("most"), F.min("component").alias("low"), F.max("component").alias("high")
        )
        # groups whose members are known to belong together need not meet
        one = (F.col("low") == F.col("high")) & (F.col("low") == F.col("o_low")) & (F.col("o_low") == F.col("o_high"))
        others = apart.select("token", F.col("gid").alias("other"), F.col("least").alias("o_least"), F.col("most").alias("o_most"),
                              F.col("low").alias("o_low"), F.col("high").alias("o_high"))
        # nor groups whose sizes are too far apart
        fits = (100 * F.col("most") >= how.percent * F.col("o_least")) & (100 * F.col("o_most") >= how.percent * F.col("least"))
        if turn < how.rounds:  # every group of a list meets two of them, in each turn others
            mask = F.lit(turn * 0x5DEECE66D1CE4E5B % (1 << 63)).cast("bigint")
            place = F.col("gid").bitwiseXOR(mask).alias("place")
            ends = F.struct(place, F.col("gid").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("least", "most", "low", "high")])
            pivots = apart.groupBy("token").agg(F.min(ends).alias("p0"), F.max(ends).alias("p1"))
            pivots = pivots.select("token", F.inline(F.array_distinct(F.array("p0", "p1"))))
            met = apart.join(pivots.hint("merge"), "token").filter((F.col("gid") != F.col("other")) & fits)
            if found is not None:
                met = met.filter(~one)
            # lists in which they meet, not all of which have the same pivots: one shared shingle may be chance
            met = met.groupBy("gid", "other", "least", "o_least").agg(F.count(F.lit(1)).alias("meets"))
            met = met.filter(F.col("meets") >= F.least(asked, F.lit(2)))
        else:  # every two groups that are still apart and share enough: all their lists are there, for all are torn
            met = apart.join(others.hint("merge"), "token").filter(fits & (F.col("gid") < F.col("other")) & ~one)
            met = met.groupBy("gid", "other", "least", "o_least").agg(F.count(F.lit(1)).alias("meets")).filter(F.col("meets") >= asked)
        pairs = met.select(F.least("gid", "other").alias("x"), F.greatest("gid", "other").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = written(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        more = opened(pairs, all_groups, how)
        if found is None:
            found = written(components(links.union(more)))
            continue
        # links between components that are known already: few, and what they join is renamed
        for side in "ab":
            more = more.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
        more = written(more.select(*[F.coalesce(f"c_{s}", s).alias(s) for s in "ab"]).filter("a <> b").distinct())
        if more.limit(1).count():
            renamed = written(components(more)).select(F.col("node").alias("old"), F.col("component").alias("new"))
            old = found.join(renamed, found["component"] == renamed["old"], "left")
            old = old.select("node", F.coalesce("new", "component").alias("component"))
            alone = renamed.join(found, renamed["old"] == found["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
            found = written(old.union(alone))
    names = by_set.select("set", F.col("rep").alias("least"))
    of_set = names.join(found, names["set"] == found["node"], "left").select("set", "least", F.coalesce("component", "set").alias("component"))
    of_set = written(of_set)
    dropped(all_groups, lists, tested)
    smallest = of_set.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of_set.join(smallest, "component").select("set", "component_id")
    return described.join(named, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )



def keep_one(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest ``doc_id``; the same columns.

    A row is named by its id and a digest of its text, so null and repeated ids are told
    apart; a null id counts as the smallest.  Of equal rows one stays.  Texts without words
    link with nothing, so all of them stay, but for equal rows.  Texts are not shuffled as
    long as the names of the rows that go are small enough to share with the tasks.
    """
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    found = join(docs.select(F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("doc_id"), "text"), how)
    names = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    names = written(
        names.select(
            F.col("doc_id.id").alias("__id"), F.col("doc_id.digest").alias("__digest"),
            (F.col("doc_id") != F.col("component_id")).alias("goes"), "n",
        ).filter("goes or n > 1")
    )
    rows = docs.withColumn("__text", digest)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest"))
    left = rows.join(sized(names.filter("goes")), same, "left_anti")
    again = names.filter("not goes")
    if again.limit(1).count():
        again = sized(again)
        once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", "__text"])
        left = left.join(again, same, "left_anti").union(once)
    return left.select(*docs.columns)
