"""Byte-exact removal of repeated strings of a fixed length, over sharded suffix arrays.

Every window of ``length`` bytes names an anchor: the place in it of the least of its hashed
``ANCHOR``-byte strings, the leftmost on ties.  The anchor is a function of the window's bytes, so
equal windows have equal anchor hashes; consecutive windows of one anchor form a segment.

1. Segments (two 64-bit hashes, place, size) are shuffled by anchor hash and sorted.  Segments equal
   in both hashes and size are copies: all but the first are repeats as a whole.  The first goes on
   only if its anchor also has other segments.
2. The bytes of those are fetched and shuffled by anchor hash.  Each task joins whole anchors into
   shards, builds the suffix array of a shard by induced sorting and the permuted common prefixes,
   and marks every window that a run of the array shows to start earlier as well.
3. Spans are gathered by document and joined to the texts.

Equal windows have equal hashes and the same distance to their anchor, so only runs of windows that share both
with another one are sorted, and the windows of an anchor with very many segments are dealt over all tasks.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import arrow_schema, batch_of, materialize, with_variant
from cuelake.llm.suffix import END, SEPARATOR, SHIFT, permuted_prefixes, suffix_array

LENGTH, ANCHOR = 100, 32
BYTES_AT_ONCE, SHARD_BYTES = 1 << 19, 1 << 21
#: an anchor with more distinct segments than this is cut into windows
HOT_SEGMENTS = 10_000
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(2)
def _powers(n: int = 2 * BYTES_AT_ONCE + LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, for one block of pieces."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of its least one, the leftmost on ties."""
    least, place, size = values, np.arange(len(values), dtype=np.int32), 1

    def join(step: int):
        left, right = least[:-step], least[step:]
        take = right < left
        return np.where(take, right, left), np.where(take, place[step:], place[:-step])

    while 2 * size <= width:
        least, place = join(size)
        size *= 2
    if size < width:
        least, place = join(width - size)
    return place


def segments(block: bytes, sizes: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Segments of concatenated texts: (text number, first window, windows, anchor hash, content hash)."""
    a = np.frombuffer(block, np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    number = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    if not len(number):
        return None
    up, down = _powers()
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
    n = len(a) - anchor + 1
    hashes = _mix((sums[anchor:] - sums[:-anchor]) * down[:n])
    place = leftmost_least((hashes >> np.uint64(32)).astype(np.uint32), length - anchor + 1)
    counts = np.bincount(number, minlength=len(sizes))
    start = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[number]
    own = place[start]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (number[1:] != number[:-1])]))
    windows = np.diff(np.append(first, len(own)))
    at = start[first]
    content = _mix((sums[at + windows + length - 1] - sums[at]) * down[at] + np.uint64(_BASE))
    return number[first], at - begins[number[first]], windows, hashes[own[first]].view(np.int64), content.view(np.int64), own[first] - at


def _texts(batch):
    """(doc_id, offset, bytes, variant) of pieces that share ``length - 1`` bytes with the next, so each window is in one."""
    for doc_id, text, variant in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
        raw = text.as_py()
        for k in range(0, max(1, len(raw) - LENGTH + 1), BYTES_AT_ONCE):
            yield doc_id, k, raw[k : k + BYTES_AT_ONCE + LENGTH - 1], variant


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it in any of the columns; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _heads(turns: np.ndarray) -> np.ndarray:
    """For each row the place of the last turn."""
    return np.flatnonzero(turns)[np.cumsum(turns) - 1]


def all_segments(docs: DataFrame) -> DataFrame:
    """(anchor, content, doc_id, variant, start, windows, lead, known): every window of every text lies in one segment.

    Of equal segments of a block of texts only the first needs to meet those of other blocks: the rest are
    ``known`` repeats and get an anchor of their own, so a very frequent string is dealt over all tasks.
    """
    schema = arrow_schema("anchor long,content long,doc_id long,variant long,start int,windows int,lead int,known boolean")

    def rows(batches):
        def flush(held):
            found = segments(b"".join(x[2] for x in held), np.array([len(x[2]) for x in held]))
            if found is not None:
                number, start, windows, anchor, content, lead = found
                ids, offsets, variants = (np.array([x[k] for x in held], np.int64) for k in (0, 1, 3))
                doc_id, start, variant = ids[number], start + offsets[number], variants[number]
                order = np.lexsort((start, variant, doc_id, windows, content, anchor))
                doc_id, variant, start, windows, anchor, content, lead = (x[order] for x in (doc_id, variant, start, windows, anchor, content, lead))
                opens = _turns(anchor, content, windows)
                known = (doc_id != doc_id[_heads(opens)]) | (start != start[_heads(opens | _turns(doc_id, variant))])
                own = _mix(doc_id.astype(np.uint64) * np.uint64(_BASE) + start.astype(np.uint64) + variant.view(np.uint64)).view(np.int64)
                yield batch_of(schema, anchor=np.where(known, own, anchor), content=content, doc_id=doc_id, variant=variant, start=start, windows=windows, lead=lead, known=known)

        for b in batches:
            held, total = [], 0
            for piece in _texts(b):
                held.append(piece)
                total += len(piece[2])
                if total >= BYTES_AT_ONCE:
                    yield from flush(held)
                    held, total = [], 0
            if held:
                yield from flush(held)

    return docs.select("doc_id", "text", "variant").mapInArrow(rows, "anchor bigint, content bigint, doc_id bigint, variant bigint, start int, windows int, lead int, known boolean")


def sort_out(segments_: DataFrame) -> DataFrame:
    """Of segments sorted by anchor, content and place: later copies (repeat) and firsts of shared anchors.

    A copy is later if its content stands in a smaller doc_id, or before it in its own text; texts of one id are not earlier
    than one another.  Only the current anchor and the first segment of it are carried from batch to batch.
    """
    schema = arrow_schema("anchor long,doc_id long,variant long,start int,windows int,lead int,repeat boolean")

    def rows(batches):
        held = None  # the last row, and the first of its anchor while that is alone
        alone = None
        opened = (0, 0, 0, 0)  # doc_id of the first segment of the current content; doc_id, variant and start of the first of its current text
        for b in batches:
            if not b.num_rows:
                continue
            anchor, content, doc_id, variant, start, windows, lead, known = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            n = len(anchor)
            last = held or (None, None, None)
            same_anchor = np.concatenate([[last[0] == anchor[0]], anchor[1:] == anchor[:-1]])
            same = same_anchor & np.concatenate([[last[1] == content[0] and last[2] == windows[0]], (content[1:] == content[:-1]) & (windows[1:] == windows[:-1])])
            # numbers of the anchor and of the segment content, from the batch's start on
            group = np.cumsum(~same_anchor)
            firsts = ~same
            kinds = np.bincount(group, weights=firsts, minlength=group[-1] + 1)
            if group[0] == 0:  # the carried anchor goes on
                kinds[0] += 1 if alone is not None else 2
            shared = firsts & (kinds[group] > 1)
            if alone is not None and group[0] == 0 and firsts[group == 0].any():
                yield batch_of(schema, **{k: [v] for k, v in alone.items()}, repeat=[False])
                alone = None
            elif group[0] == 1:
                alone = None
            # rows of the same place as the first of their text are that first again, not copies of it; the first in another text of
            # the same id is a first too, and goes on whether or not its anchor is shared
            texts = np.concatenate([[not same[0] or (doc_id[0], variant[0]) != opened[1:3]], firsts[1:] | (doc_id[1:] != doc_id[:-1]) | (variant[1:] != variant[:-1])])
            lead_doc = np.append(opened[0], doc_id[firsts])[np.cumsum(firsts)]
            text_start = np.append(opened[3], start[texts])[np.cumsum(texts)]
            opened = (lead_doc[-1], doc_id[-1], variant[-1], text_start[-1])
            later = same & ((doc_id != lead_doc) | (start != text_start)) | known
            take = later | shared | (same & texts & ~later)
            if take.any():
                yield batch_of(schema, anchor=anchor[take], doc_id=doc_id[take], variant=variant[take], start=start[take], windows=windows[take], lead=lead[take], repeat=later[take])
            if group[-1] > 0 and kinds[group[-1]] == 1:
                k = int(np.flatnonzero(firsts & (group == group[-1]))[0])
                alone = {"anchor": anchor[k], "doc_id": doc_id[k], "variant": variant[k], "start": start[k], "windows": windows[k], "lead": lead[k]}
            elif group[-1] > 0:
                alone = None
            held = (anchor[n - 1], content[n - 1], windows[n - 1])

    ordered = segments_.repartition("anchor").sortWithinPartitions("anchor", "content", "windows", "doc_id", "variant", "start")
    return ordered.mapInArrow(rows, "anchor bigint, doc_id bigint, variant bigint, start int, windows int, lead int, repeat boolean")


def earlier_windows(regions: list[bytes], doc_ids: np.ndarray, starts: np.ndarray, length: int = LENGTH, variants: np.ndarray | None = None):
    """(region, window) of each window of a region that also starts in a smaller doc_id, or earlier in its own text."""
    variants = np.zeros(len(doc_ids), np.int64) if variants is None else variants
    sizes = np.array([len(x) for x in regions])
    begins = np.cumsum(sizes + 1) - sizes - 1
    t = np.full(int(begins[-1] + sizes[-1]) + 2, SEPARATOR, np.uint16)
    number = np.repeat(np.arange(len(regions)), sizes)
    inside = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    t[begins[number] + inside] = np.frombuffer(b"".join(regions), np.uint8).astype(np.uint16) + SHIFT
    t[-1] = END
    sa = suffix_array(t)
    owner = np.full(len(t), -1, np.int32)
    whole = inside <= sizes[number] - length
    owner[(begins[number] + inside)[whole]] = number[whole]
    prefixes = permuted_prefixes(t, sa, length, owner >= 0)
    joined = prefixes[sa] >= length
    group = np.cumsum(~joined)
    own = owner[sa]
    keep = own >= 0
    group, own, at = group[keep], own[keep], sa[keep] - begins[own[keep]]
    place = starts[own] + at
    if not len(group):
        return own, at
    order = np.lexsort((place, variants[own], doc_ids[own], group))
    group, own, at, place = group[order], own[order], at[order], place[order]
    opens = _turns(group)
    later = (doc_ids[own] != doc_ids[own[_heads(opens)]]) | (place != place[_heads(opens | _turns(doc_ids[own], variants[own]))])
    return own[later], at[later]


def shared_runs(regions: list[bytes], anchors: np.ndarray, leads: np.ndarray, length: int = LENGTH):
    """(region, first window, end window) of the runs of windows whose hash and distance another window of their anchor has.

    Equal windows are never left out, so what is sorted afterwards holds them all.
    """
    sizes = np.array([len(x) for x in regions])
    windows = sizes - length + 1
    ends, begins = np.cumsum(sizes), np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(regions)), windows)
    k = np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = begins[own] + k
    up, down = _powers(max(2 * BYTES_AT_ONCE + LENGTH, 1 << int(ends[-1]).bit_length()))
    sums = np.zeros(ends[-1] + 1, np.uint64)
    np.cumsum((np.frombuffer(b"".join(regions), np.uint8).astype(np.uint64) + np.uint64(1)) * up[: ends[-1]], out=sums[1:])
    keys = _mix((sums[at + length] - sums[at]) * down[at])
    keys ^= _mix((anchors.astype(np.uint64)[own] * np.uint64(_BASE)) ^ (leads[own] - k).astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    found = np.flatnonzero(shared)
    if not len(found):
        return found, found, found
    opens = np.concatenate([[True], (np.diff(found) > 1) | (own[found[1:]] != own[found[:-1]])])
    first, last = found[opens], found[np.append(opens[1:], True)]
    return own[first], k[first], k[last] + 1


def _marks(regions: DataFrame) -> DataFrame:
    """(doc_id, variant, first, last): spans of bytes in the repeated windows of regions (anchor, doc_id, variant, start, lead, bytes).

    A region without bytes is a window that is known to repeat.
    """
    schema = arrow_schema("doc_id long,variant long,first int,last int")

    def shard(rows):
        anchors, docs, variants, starts, leads = (np.array([x[k] for x in rows], np.int64) for k in range(5))
        region, low, high = shared_runs([x[5] for x in rows], anchors, leads)
        if not len(region):
            return
        docs, variants, starts = docs[region], variants[region], starts[region] + low
        own, at = earlier_windows([rows[r][5][p : q + LENGTH - 1] for r, p, q in zip(region.tolist(), low.tolist(), high.tolist(), strict=True)], docs, starts, LENGTH, variants)
        if not len(own):
            return
        order = np.lexsort((at, own))
        own, at = own[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.append(first[1:], len(own)) - 1
        yield batch_of(schema, doc_id=docs[own[first]], variant=variants[own[first]], first=starts[own[first]] + at[first], last=starts[own[first]] + at[last] + LENGTH)

    def rows(batches):
        held, held_bytes, group = [], 0, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            known = [k for k, x in enumerate(columns[5]) if not x]
            if known:
                starts = np.array([columns[3][k] for k in known])
                yield batch_of(schema, doc_id=[columns[1][k] for k in known], variant=[columns[2][k] for k in known], first=starts, last=starts + LENGTH)
            for row in zip(*columns, strict=True):
                if not row[5]:
                    continue
                if group and group[0][0] != row[0]:
                    held += group
                    group = []
                    if held_bytes > SHARD_BYTES:
                        yield from shard(held)
                        held, held_bytes = [], 0
                group.append(row)
                held_bytes += len(row[5])
        if held or group:
            yield from shard(held + group)

    ordered = regions.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.select("anchor", "doc_id", "variant", "start", "lead", "bytes").mapInArrow(rows, "doc_id bigint, variant bigint, first int, last int")


def _fetch(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The bytes of segments, from the texts of their documents.

    The segments of an anchor that has very many are cut into windows, each under an anchor of its own that its bytes and
    distance name, so they are dealt over all tasks.  Of equal windows of a batch only the first has to meet
    those of other batches; the others are known to repeat and carry no bytes.
    """
    schema = arrow_schema("anchor long,doc_id long,variant long,start int,lead int,bytes binary")
    crowds = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_SEGMENTS).select("anchor", F.lit(True).alias("hot"))
    marked = firsts.join(crowds, "anchor", "left")
    wanted = marked.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("anchor", "start", "windows", "lead", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))

    def rows(batches):
        for b in batches:
            out = {f.name: [] for f in schema}
            hot = []
            for doc_id, variant, text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), b.column(3), strict=True):
                for x in parts.as_py():
                    start = x["start"]
                    if x["hot"]:
                        hot += [(text[start + k : start + k + LENGTH], doc_id, variant, start + k, x["lead"] - k, x["anchor"]) for k in range(x["windows"])]
                        continue
                    for name, v in zip(out, (x["anchor"], doc_id, variant, start, x["lead"], text[start : start + x["windows"] + LENGTH - 1]), strict=True):
                        out[name].append(v)
                if len(out["bytes"]) > 20_000 or len(hot) > 100_000:
                    yield from split(hot)
                    yield batch_of(schema, **out)
                    out, hot = {f.name: [] for f in schema}, []
            yield from split(hot)
            yield batch_of(schema, **out)

    def split(hot):
        seen, own, found = {}, {}, []
        for raw, doc_id, variant, start, lead, anchor in sorted(hot, key=lambda x: x[1:4]):
            again = seen.setdefault(raw, doc_id) != doc_id or own.setdefault((raw, variant), start) != start
            key = doc_id ^ start if again else xxhash.xxh3_64_intdigest(raw, (anchor ^ lead) & (1 << 64) - 1) - (1 << 63)
            found.append((key, doc_id, variant, start, lead, b"" if again else raw))
        if found:
            yield batch_of(schema, **dict(zip(schema.names, zip(*found, strict=True), strict=True)))

    return docs.join(wanted, ["doc_id", "variant"]).select("doc_id", "variant", "text", "wanted").mapInArrow(rows, "anchor bigint, doc_id bigint, variant bigint, start int, lead int, bytes binary")


def merged(firsts: np.ndarray, lasts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal runs of places that half-open spans cover, within a text of that size."""
    order = np.argsort(firsts)
    firsts, reach = firsts[order], np.maximum.accumulate(lasts[order])
    opens = np.flatnonzero(np.concatenate([[True], firsts[1:] > reach[:-1]]))
    stops = np.minimum(reach[np.append(opens[1:], len(firsts)) - 1], size)
    return [(x, y) for x, y in zip(firsts[opens].tolist(), stops.tolist(), strict=True) if x < y]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<first,last>>, kept binary), one row for each input row.

    ``spans`` are the maximal removed runs of bytes, half open; ``kept`` is the rest.  A null text is
    empty.  A row without an id keeps its text and is nobody's earlier occurrence.  Rows of equal id are
    documents of their own, none earlier than another: each loses what stands under a smaller id or earlier in itself.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_variant(rows)
    named = rows.where("doc_id is not null")
    parts = all_segments(named)
    found = materialize(sort_out(parts), "segments")
    whole = found.where("repeat").select("doc_id", "variant", F.col("start").alias("first"), (F.col("start") + F.col("windows") + (LENGTH - 1)).alias("last"))
    marked = _marks(_fetch(named, found.where("not repeat")))
    spans = whole.unionByName(marked).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("first", "last")).alias("found"))
    joined = rows.join(spans, ["doc_id", "variant"], "left").select("doc_id", "text", "found")
    pair = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pair)), ("kept", pa.binary())])

    def cut(batches):
        for b in batches:
            sizes, spans_, kept = [], [], []
            flat = b.column(2).flatten()
            firsts, lasts = (flat.field(k).to_numpy() for k in (0, 1))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy())
            for raw, p, q in zip(b.column(1).cast(pa.binary()).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                sizes.append(len(raw))
                if p == q:
                    spans_.append([])
                    kept.append(raw)
                    continue
                runs = merged(firsts[p:q], lasts[p:q], len(raw))
                spans_.append([{"first": x, "last": y} for x, y in runs])
                kept.append(b"".join(raw[x:y] for (_, x), (y, _) in zip([(0, 0), *runs], [*runs, (len(raw), 0)], strict=True)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans_, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)

    return joined.mapInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<first: int, last: int>>, kept binary")
