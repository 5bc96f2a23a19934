"""Chroma audio fingerprints of media columns: integral-image filters over pitch-class frames give packed integers;
offset histograms and bit errors align recordings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bounded_batches, texts, written
from .components import connected_components
from .near_dedup import RUN, U, joined_parts, mixed, open_buckets, probable, with_classes

RATE = 8000
WIDTH = 8  # frames under the widest filter
AT_ONCE = 1 << 20  # samples
#: The integers kept with an anchor, by their distance from it: two in a word with 16 bits each, or four with 8 bits each.
AROUND = ((1, 2), (3, 4), (5, 6), (-1, -2), (-3, -4), (-5, -6), (7, -7), (9, 12, 17, 24), (-9, -12, -17, -24), (34, -34, 48, -48))
FAR = 48


def filters() -> list[tuple[int, int, int, int]]:
    """16 filters (kind, first pitch class, pitch classes, frames): six kinds of comparing two halves of a rectangle."""
    return [(i % 6, (5 * i) % 12, 2 + i % 5, 2 + 2 * (i % 4)) for i in range(16)]


def pitch_frames(view: np.ndarray) -> np.ndarray:
    """12 pitch-class energies of each row of 8-bit PCM samples, scaled to length 1 (silence stays 0).

    They are multiples of 2**-30, so sums of them are exact, in any order.
    """
    frame = view.shape[1]
    hz = np.arange(frame // 2 + 1) * RATE / frame
    use = np.flatnonzero((hz >= 120) & (hz <= 3500))
    pitch = np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), pitch] = 1
    window = np.hanning(frame) / 128
    step = max(WIDTH, AT_ONCE // frame)
    out = np.empty((len(view), 12))
    for a in range(0, len(view), step):
        spectrum = np.fft.rfft((view[a : a + step].astype(np.float64) - 128) * window, axis=1)[:, use]
        energy = (spectrum.real**2 + spectrum.imag**2) @ fold
        size = np.sqrt((energy**2).sum(axis=1, keepdims=True))
        out[a : a + step] = np.where(size > 1e-9, energy / np.maximum(size, 1e-9), 0)
    return np.rint(out * 2.0**30) * 2.0**-30


def n_frames(size: int, frame: int, hop: int) -> int:
    return max(WIDTH, 1 + max(0, size - frame) // hop)


def chroma(samples: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Frames of 12 pitch-class energies (see pitch_frames) of 8-bit PCM samples."""
    x = np.full((n_frames(len(samples), frame, hop) - 1) * hop + frame, 128, dtype=np.uint8)
    m = min(len(x), len(samples))
    x[:m] = samples[:m]
    return pitch_frames(np.lib.stride_tricks.sliding_window_view(x, frame)[::hop])


def filtered(frames: np.ndarray) -> np.ndarray:
    """A packed integer for each run of WIDTH frames."""
    # The pitch classes go around: a second octave lets filters cross the end.
    image = np.zeros((25, len(frames) + 1))
    image[1:, 1:] = np.cumsum(np.cumsum(np.hstack([frames, frames]).T, axis=1), axis=0)
    n = len(frames) - WIDTH + 1

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[p1, t1 : t1 + n] - image[p1, t0 : t0 + n] - image[p0, t1 : t1 + n] + image[p0, t0 : t0 + n]

    code = np.zeros(n, dtype=np.uint32)
    low, high = np.exp(-0.1), np.exp(0.1)
    for kind, y, height, width in filters():
        a, b, h2, w2, h3, w3 = y, y + height, y + height // 2, width // 2, max(1, height // 3), max(1, width // 3)
        if kind == 0:  # all of it
            one, two = area(0, width, a, b), area(0, width, b, min(24, b + height))
        elif kind == 1:  # low and high
            one, two = area(0, width, a, h2), area(0, width, h2, b)
        elif kind == 2:  # early and late
            one, two = area(0, w2, a, b), area(w2, width, a, b)
        elif kind == 3:  # across
            one, two = area(0, w2, a, h2) + area(w2, width, h2, b), area(0, w2, h2, b) + area(w2, width, a, h2)
        elif kind == 4:  # the middle of the pitches
            two = area(0, width, a + h3, max(a + h3 + 1, b - h3))
            one = area(0, width, a, b) - two
        else:  # the middle of the time
            two = area(w3, max(w3 + 1, width - w3), a, b)
            one = area(0, width, a, b) - two
        # log((1 + one) / (1 + two)) against -0.1, 0 and 0.1
        one, two = 1 + one, 1 + two
        level = (one > two * low).astype(np.uint32) + (one > two) + (one > two * high)
        code = (code << np.uint32(2)) | (level ^ (level >> np.uint32(1))).astype(np.uint32)  # Gray code: neighbours differ in a bit
    return code


def all_fingerprints(recordings: list[bytes], frame: int = 1024, hop: int = 256) -> list[np.ndarray]:
    """The fingerprint of each recording: a packed integer for each run of WIDTH frames; no samples, no integers.
    Shorter recordings end in silence. They are worked on side by side, in whole arrays."""
    some = [x for x in recordings if x]
    if not some:
        return [np.zeros(0, dtype=np.uint32) for _ in recordings]
    n = np.array([n_frames(len(x), frame, hop) for x in some])
    sizes = (n - 1) * hop + frame
    x = np.frombuffer(b"".join(r[:s] + b"\x80" * (s - len(r)) for r, s in zip(some, sizes.tolist(), strict=True)), dtype=np.uint8)
    first = np.cumsum(n) - n
    at = np.repeat(np.cumsum(sizes) - sizes, n) + (np.arange(n.sum()) - np.repeat(first, n)) * hop
    view = np.lib.stride_tricks.sliding_window_view(x, frame)
    step = max(WIDTH, AT_ONCE // frame)
    code = []
    for a in range(0, len(at) - WIDTH + 1, step):
        code.append(filtered(pitch_frames(view[at[a : a + step + WIDTH - 1]])))
    code = np.concatenate(code)
    parts = iter([code[a : a + m - WIDTH + 1] for a, m in zip(first.tolist(), n.tolist(), strict=True)])
    return [next(parts) if r else np.zeros(0, dtype=np.uint32) for r in recordings]


def fingerprint(data: bytes, frame: int = 1024, hop: int = 256) -> np.ndarray:
    """The packed integers of one recording (see all_fingerprints)."""
    return all_fingerprints([data], frame, hop)[0]


def offset_votes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The offset histogram: how many bits agree when b is moved by each offset from 1 - len(a) to len(b) - 1.

    Every two integers vote for the offset between them with as many votes as bits they share. The counts are exact,
    by cross-correlations of the 32 bits, so time goes by n log n also where recordings repeat themselves.
    """
    size = 1 << (len(a) + len(b) - 1).bit_length()
    total = np.zeros(size)
    step = max(1, (1 << 20) // size)  # bits at a time
    for bit in range(0, 32, step):
        shifts = np.arange(bit, min(32, bit + step), dtype=np.uint32)[:, None]
        sa, sb = (((x[None, :] >> shifts) & np.uint32(1)) * 2.0 - 1.0 for x in (a, b))
        total += np.fft.irfft((np.conj(np.fft.rfft(sa, size)) * np.fft.rfft(sb, size)).sum(axis=0), size)
    o = np.arange(1 - len(a), len(b))
    over = np.minimum(len(a), len(b) - o) - np.maximum(0, -o)
    return (np.rint(total[o % size]).astype(np.int64) + 32 * over) // 2


def align(a: np.ndarray, b: np.ndarray, least: int = 8) -> tuple[int, float, int]:
    """(offset, share of wrong bits, integers compared) of the best alignment of b against a; the share is 1 without any.

    An alignment must cover `least` integers and half of the shorter recording; of equal ones the longest counts, then the least offset.
    """
    if not len(a) or not len(b):
        return 0, 1.0, 0
    votes, o = offset_votes(a, b), np.arange(1 - len(a), len(b))
    over = np.minimum(len(a), len(b) - o) - np.maximum(0, -o)
    ok = np.flatnonzero(over >= max(least, (min(len(a), len(b)) + 1) // 2))
    if not len(ok):
        return 0, 1.0, 0
    wrong = 1 - votes[ok] / (32 * over[ok])
    best = ok[np.lexsort((np.abs(o[ok]), -over[ok], wrong))[0]]
    return int(o[best]), float(1 - votes[best] / (32 * over[best])), int(over[best])


def band_masks(bands: int, parts: int, seed: int = 1) -> np.ndarray:
    """For each band the bits of `parts` of the 16 filters, in an order from the seed."""
    rng = np.random.default_rng(seed)
    return np.array([sum(3 << 2 * int(f) for f in rng.permutation(16)[:parts]) for _ in range(bands)], dtype=np.uint32)


def anchors(codes: np.ndarray, starts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each recording (from each of `starts` on) and mask the least hash of the masked integers, and the first place that has it."""
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(codes))))
    least, place = np.empty((len(starts), len(masks)), dtype=U), np.empty((len(starts), len(masks)), dtype=np.int64)
    with np.errstate(over="ignore"):
        for i, mask in enumerate(masks):
            h = mixed(((codes & mask).astype(U) | U(i + 1) << U(32)) * U(0x9E3779B97F4A7C15))
            least[:, i] = np.minimum.reduceat(h, starts)
            at = np.flatnonzero(h == least[owner, i])
            place[:, i] = at[np.searchsorted(owner[at], np.arange(len(starts)))]
    return least.view(np.int64), place


def band_hashes(codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """For each mask the least hash of the masked integers."""
    return anchors(codes, np.zeros(1, dtype=np.int64), masks)[0][0]


def fingerprints(recordings: DataFrame, audio_col: str = "audio", frame: int = 1024, hop: int = 256) -> DataFrame:
    """recordings with `codes` (packed integers, 4 bytes each) instead of the audio."""
    rest = [c for c in recordings.columns if c != audio_col]
    schema = T.StructType([*(recordings.schema[c] for c in rest), T.StructField("codes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, audio_col):
            packed = [c.astype("<u4").tobytes() for c in all_fingerprints(texts(batch, audio_col), frame, hop)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(packed, pa.binary())], names=schema.names)

    return recordings.mapInArrow(run, schema)


def kept_bits() -> list[tuple[int, int, np.uint32]]:
    """(word of a sample, distance from the anchor, bits of the integer there that the word has)."""
    kinds = {2: (0xAAAAAAAA, 0x55555555), 4: (0x11111111, 0x22222222, 0x44444444, 0x88888888)}
    return [(k, d, np.uint32(bits)) for k, word in enumerate(AROUND) for d, bits in zip(word, kinds[len(word)], strict=True)]


def anchored(nodes: DataFrame, bands: int, parts: int) -> DataFrame:
    """Rows (hash, node, sample), one for each band, for nodes (node, codes) of 8 integers or more.

    A band looks at `parts` of the 16 filters only, so that recordings whose integers have wrong bits still meet in
    bands that don't look at these. Its hash is that of one integer, the anchor; `sample` has bits of the integers around
    it (0 beyond the ends; see AROUND), and how many stand before it and from it on.
    """
    masks = band_masks(bands, parts)
    schema = T.StructType([T.StructField("hash", T.LongType()), nodes.schema["node"], T.StructField("sample", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "codes", 1 << 18):
            packed = texts(batch, "codes")
            size = np.array([len(x) // 4 for x in packed])
            codes, starts = np.frombuffer(b"".join(packed), dtype="<u4"), np.cumsum(size) - size
            least, place = anchors(codes, starts, masks)
            before = place - starts[:, None]
            after = size[:, None] - before
            sample = np.zeros((*place.shape, len(AROUND) + 2), dtype="<u4")
            for k, d, bits in kept_bits():
                inside = (before + d >= 0) & (d < after)
                sample[:, :, k] |= np.where(inside, codes[np.where(inside, place + d, 0)], 0) & bits
            sample[:, :, -2], sample[:, :, -1] = before, after
            data, width = pa.py_buffer(sample.tobytes()), sample.shape[2] * 4
            n = least.size
            cells = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays([pa.array(least.ravel()), batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), bands))), cells], names=schema.names)

    return nodes.where("octet_length(codes) >= 32").select("node", "codes").mapInArrow(run, schema)


class Likeness:
    """Whether samples (see anchored), with their anchors one upon the other, are like enough for a link at a share of wrong bits.

    They overlap over 8 integers and half of the shorter recording, and of the bits that both have at most 1.6 times that
    share differ, or the share and 4 standard deviations of as many draws if that is more: few bits tell less. The
    anchors themselves, which agree in most bits wherever recordings meet, don't count.
    """

    def __init__(self, wrong_bits: float):
        before, after = (np.zeros((FAR + 2, len(AROUND)), dtype="<u4") for _ in range(2))
        for k, d, bits in kept_bits():
            before[max(0, -d) :, k] |= bits if d < 0 else np.uint32(0)
            after[d + 1 :, k] |= bits if d > 0 else np.uint32(0)
        # Words of 64 bits; by how many integers both have before the anchors, and from them on.
        self.before, self.after = before.view("<u8"), after.view("<u8")
        self.n_before, self.n_after = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (before, after))
        n = np.arange(self.n_before[-1] + self.n_after[-1] + 1)
        self.most = np.floor(np.maximum(1.6 * wrong_bits * n, wrong_bits * n + 4 * np.sqrt(max(0.0, wrong_bits * (1 - wrong_bits)) * n)) + 1e-6)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low = np.minimum(x[:, -2:], y[:, -2:]).astype(np.int64)
        before, after = low[:, 0], low[:, 1]
        shorter = np.minimum(x[:, -2] + x[:, -1], y[:, -2] + y[:, -1]).astype(np.int64)
        out = np.zeros(len(before), dtype=bool)
        at = np.flatnonzero(before + after >= np.maximum(8, (shorter + 1) // 2))
        before, after = np.minimum(before[at], FAR + 1), np.minimum(after[at], FAR + 1)
        one, two = ((z if len(z) == 1 else z[at]).view("<u8")[:, :-1] for z in (x, y))
        wrong = np.bitwise_count((one ^ two) & (self.before[before] | self.after[after])).sum(axis=1, dtype=np.int64)
        out[at] = wrong <= self.most[self.n_before[before] + self.n_after[after]]
        return out


def samples_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(len(column), -1)


def longer_first(s: np.ndarray, node: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with the longer recording first, or else the lesser node, so that each pair has one form."""
    size = s[:, -2] + s[:, -1]
    swap = (size[q] > size[p]) | (size[q] == size[p]) & (node[q] < node[p])
    return np.where(swap, q, p), np.where(swap, p, q)


def bucket_pairs(rows: DataFrame, wrong_bits: float, large: int = 2048, each: int = 16) -> DataFrame:
    """Rows (hash, a, b, sample) from rows (hash, node, sample): the pairs (a, b) of a bucket whose samples are alike
    (see Likeness), the longer recording first, their sample null, and rows (hash, a, null, sample) of the buckets that are left to later.

    Rows are range-partitioned by bucket, sample and node, so a large bucket spreads over tasks. Left to later are
    buckets that may span tasks, those of more than `large` nodes, and those with more than `each` pairs for each node:
    of these, pairs come only from neighbours and with the first, which join most of a group of copies.
    """
    schema = T.StructType([T.StructField("hash", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("sample", T.BinaryType())])
    alike = Likeness(wrong_bits)

    def within(t: pa.Table, first: bool, last: bool, going_on: bool) -> Iterator[pa.RecordBatch]:
        """Whole buckets; the first or last may be one that spans tasks. If going_on, its first row was in the table before."""
        h, s, node = t.column("hash").to_numpy(), samples_of(t.column("sample")), t.column("node").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
        size = np.diff(edge)
        bucket = np.repeat(np.arange(len(size)), size)
        later = size > large
        later[0] |= first
        later[-1] |= last
        at, lag, found = np.flatnonzero(~later[bucket]), 1, []
        n_pairs = np.zeros(len(size), dtype=np.int64)
        while len(at):
            at = at[at + lag < edge[bucket[at] + 1]]
            for i in range(0, len(at), 1 << 15):
                p = at[i : i + (1 << 15)]
                p = p[alike(s[p], s[p + lag])]
                found.append(np.stack([p, p + lag]))
                n_pairs += np.bincount(bucket[p], minlength=len(size))
            lag += 1
        later |= n_pairs > each * size
        a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        keep = ~later[bucket[a]]
        at = np.flatnonzero(later[bucket])
        at = at[at > edge[bucket[at]]]
        hub = edge[bucket[at]]
        a, b = np.concatenate([a[keep], hub, at[at - 1 > hub] - 1]), np.concatenate([b[keep], at, at[at - 1 > hub]])
        starred = np.arange(len(a)) >= keep.sum()
        for i in range(0, len(a), 1 << 14):
            p, q = a[i : i + (1 << 14)], b[i : i + (1 << 14)]
            ok = ~starred[i : i + (1 << 14)] | alike(s[p], s[q])
            p, q = p[ok], q[ok]
            p, q = longer_first(s, node, p, q)
            yield pa.RecordBatch.from_arrays([pa.array(h[p]), pa.array(node[p]), pa.array(node[q]), pa.nulls(len(p), pa.binary())], names=schema.names)
        at = np.flatnonzero(later[bucket])
        at = at[1:] if going_on else at
        for i in range(0, len(at), 1 << 14):
            p = at[i : i + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(h[p]), pa.array(node[p]), pa.nulls(len(p), pa.int64()), pa.array([x.tobytes() for x in s[p]], pa.binary())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, first, going_on = [], 0, True, False
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 1 << 15:
                continue
            t = pa.Table.from_batches(held)
            h = t.column("hash").to_numpy()
            cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
            if cut:
                yield from within(t.slice(0, cut), first, False, going_on)
                first, going_on, rest = False, False, t.slice(cut)
            else:  # one bucket, and more of it may come: its first row stays for what follows
                yield from within(t, True, True, going_on)
                first, going_on, rest = True, True, t.slice(0, 1)
            held, n = rest.to_batches(), rest.num_rows
        if n > going_on:
            yield from within(pa.Table.from_batches(held), first, True, going_on)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["hash", "sample", "node"]
    return written(rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "bucket-pairs")


def aligning(pairs: list[tuple[np.ndarray, np.ndarray]], wrong_bits: float, least: int = 8) -> np.ndarray:
    """For each pair of recordings whether they align: the exact counts of all offsets, of pairs of like lengths side by side."""
    out = np.zeros(len(pairs), dtype=bool)
    sizes = np.array([(min(len(a), len(b)), max(len(a), len(b))) for a, b in pairs]).reshape(-1, 2)
    long = sizes[:, 0] * sizes[:, 1] > 1 << 21
    for i in np.flatnonzero(long).tolist():
        out[i] = align(*pairs[i], least)[1] <= wrong_bits
    todo = np.flatnonzero(~long & (sizes[:, 0] >= least))
    step = np.ceil(np.log(np.maximum(sizes, 1)) / np.log(1.3)).astype(int)
    todo = todo[np.lexsort((step[todo, 1], step[todo, 0]))]
    edge = np.flatnonzero(np.concatenate([[True], (step[todo][1:] != step[todo][:-1]).any(axis=1), [True]])) if len(todo) else np.zeros(0, dtype=int)
    for lo, hi in zip(edge, edge[1:], strict=False):
        most = max(1, (1 << 18) // int(sizes[todo[lo:hi], 1].max()))
        for c in range(lo, hi, most):
            some = todo[c : min(hi, c + most)]
            k, m = sizes[some, 0], sizes[some, 1]
            short, tall = np.zeros((len(some), k.max()), dtype=np.uint32), np.zeros((len(some), m.max()), dtype=np.uint32)
            for r, i in enumerate(some.tolist()):
                a, b = sorted(pairs[i], key=len)
                short[r, : len(a)], tall[r, : len(b)] = a, b
            inside = np.where(np.arange(m.max()) < m[:, None], 255, 0).astype(np.uint8)
            wrong = np.zeros((len(some), k.max() + m.max() - 1), dtype=np.uint16 if k.max() < 2048 else np.uint32)
            for t in range(k.max()):  # the offset is place - t
                bits = np.bitwise_count(tall ^ short[:, t : t + 1]) & inside
                if t >= k.min():
                    bits[t >= k] = 0
                wrong[:, k.max() - 1 - t : k.max() - 1 - t + m.max()] += bits
            o = np.arange(1 - k.max(), m.max())
            over = np.minimum(k[:, None], m[:, None] - o) - np.maximum(0, -o)
            ok = (over >= np.maximum(least, (k + 1) // 2)[:, None]) & (wrong <= wrong_bits * 32 * over + 1e-6)
            out[some] = ok.any(axis=1)
    return out


def aligned(pairs: DataFrame, nodes: DataFrame, wrong_bits: float) -> DataFrame:
    """(a, b, shift, wrong, compared) for the pairs (a, b, run) whose recordings, from nodes (node, codes), align with at most that share of wrong bits."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"], T.StructField("shift", T.LongType()), T.StructField("wrong", T.DoubleType()), T.StructField("compared", T.LongType())])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def found(names: list[tuple], both: list[tuple]) -> pa.RecordBatch:
        at = np.flatnonzero(aligning(both, wrong_bits)).tolist()
        rows = [(*names[i], *align(*both[i])) for i in at]
        rows = [r for r in rows if r[3] <= wrong_bits]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, names, both, size = np.zeros(0, dtype="<u4"), [], [], 0
        for batch in blocks(batches, "codes"):
            for a, b, codes in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), texts(batch, "codes"), strict=True):
                own = np.frombuffer(codes, dtype="<u4")
                if b is None:
                    head = own
                else:
                    names.append((a, b))
                    both.append((head, own))
                size += len(own)
            if len(both) >= 8192 or size >= 1 << 21:
                yield found(names, both)
                names, both, size = [], [], 0
        yield found(names, both)

    return dealt_codes(pairs, nodes).mapInArrow(run, schema)


def dealt_codes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (a, run, b, codes) for pairs (a, b, run): in each run the row of `a` itself, its b null, comes first and those
    of its partners after it, all in one task. nodes are (node, codes).

    Both ends of the pairs get their codes in one join, and most nodes that are in no pair stay out of it.
    """
    heads = pairs.select("a", "run", F.lit(None).cast(pairs.schema["b"].dataType).alias("b"), F.col("a").alias("node")).distinct()
    ends = heads.union(pairs.select("a", "run", "b", F.col("b").alias("node")))
    return ends.join(probable(nodes, ends.select("node")), "node").select("a", "run", "b", "codes").repartition("a", "run").sortWithinPartitions("a", "run", "b")


def in_runs(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with a `run` of about RUN partners of one first, so that they can be dealt to several tasks."""
    many = written(pairs.groupBy("a").count().where(F.col("count") > RUN), "many-partners")  # few, so that Spark can broadcast them
    runs = F.ceil(F.col("count") / RUN)
    return pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), runs), F.lit(0)).cast("int").alias("run"))


def open_pairs(rows: DataFrame, wrong_bits: float, block: int = 1024) -> DataFrame:
    """The pairs (a, b), the longer recording first, of nodes of one bucket but different parts whose samples are alike
    (see Likeness): rows are (hash, n, node, part, sample), n the bucket's number of nodes.

    A bucket of more nodes than a block is cut, and each pair of blocks is a group of its own.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    alike = Likeness(wrong_bits)

    def compare(group: pa.Table) -> pa.Table:
        node, part, own = (group.column(c).to_numpy() for c in ("node", "part", "own"))
        s, i, j = samples_of(group.column("sample")), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right, found = np.flatnonzero(own == i), np.flatnonzero(own == j), [np.zeros((2, 0), dtype=np.int64)]
        for p in left.tolist():
            q = right[(part[right] != part[p]) & ((i != j) | (right > p))]
            q = q[alike(s[q], s[p : p + 1])]
            found.append(np.stack([np.full(len(q), p), q]))
        p, q = np.concatenate(found, axis=1)
        p, q = longer_first(s, node, p, q)
        return pa.table({"a": pa.array(node[p]), "b": pa.array(node[q])})

    n_blocks = F.ceil(F.col("n") / block).cast("int")
    cut = rows.withColumn("own", F.pmod(F.xxhash64("node"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    cut = cut.select("hash", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "part", "sample")
    return cut.groupBy("hash", "i", "j").applyInArrow(compare, schema).distinct()


def recording_classes(recordings: DataFrame, id_col: str = "doc_id", audio_col: str = "audio", wrong_bits: float = 0.1, bands: int = 40, parts: int = 11, frame: int = 1024, hop: int = 256, large: int = 2048) -> DataFrame:
    """(doc_id, class_id, class_size, n_codes, codes): a row for each row of recordings (8-bit mono PCM, 8 kHz).

    A class is a connected component of recordings that align: at the best offset of the histogram at most wrong_bits
    of the bits differ, over 8 integers and half of the shorter one at least. class_id is its least doc_id. Equal
    recordings are one node of the graph, in one class whatever their length. Null and empty recordings have no
    integers and are classes of their own; an empty table gives no rows.

    Candidates share a band or more whose anchors have like integers around them (320 bits of 26 integers, up to 48 away;
    see Likeness); every two of a bucket are looked at. Buckets of more than `large` nodes, or of very many
    candidates, are linked by neighbours first; where that leaves more than one class, all their nodes of different
    classes are compared, by blocks. Each candidate is aligned once, however many bands it shares.
    """
    bounded_batches(recordings.sparkSession)
    audio = F.coalesce(F.col(audio_col), F.to_binary(F.lit(""), F.lit("hex")))
    kept = recordings.select(F.col(id_col).alias("doc_id"), F.xxhash64(audio).alias("t1"), F.xxhash64(F.lit(20241), audio).alias("t2"), audio.alias("audio"))
    signed = written(fingerprints(kept, "audio", frame, hop), "fingerprints")
    node = F.concat(F.to_binary(F.lpad(F.hex("t1"), 16, "0"), F.lit("hex")), F.to_binary(F.lpad(F.hex("t2"), 16, "0"), F.lit("hex")))
    signed = signed.withColumn("node", F.when(F.octet_length("codes") > 0, node)).drop("t1", "t2")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.first("codes").alias("codes"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    # Rows get a short number where they are written: 40 bands of each name it.
    nodes = written(nodes.withColumnRenamed("node", "name").withColumn("node", F.monotonically_increasing_id()), "recordings")
    found = bucket_pairs(anchored(nodes, bands, parts), wrong_bits, large)
    pairs = written(found.where("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    codes = nodes.select("node", "codes")
    named = connected_components(written(aligned(written(in_runs(pairs), "likely"), codes, wrong_bits).select("a", "b"), "alignments"))
    rest = found.where("b IS NULL").select(F.lit(0).alias("band"), "hash", F.col("a").alias("node"), "sample")
    size = codes.select("node", F.octet_length("codes").cast("long").alias("bytes"))
    rest = open_buckets(rest.join(size, "node"), named, 1)
    if not rest.isEmpty():
        more = aligned(written(in_runs(written(open_pairs(rest, wrong_bits), "open-pairs")), "likely"), codes, wrong_bits).select("a", "b")
        named = joined_parts(named, written(more, "more-alignments"))
    names = nodes.select("node", "name")
    named = named.join(names, "node").join(names.toDF("component", "of"), "component").select(F.col("name").alias("node"), F.col("of").alias("component"))
    out = with_classes(signed, nodes.select(F.col("name").alias("node"), "least_id", "copies"), named)
    return out.select("doc_id", "class_id", "class_size", (F.octet_length("codes") / 4).cast("long").alias("n_codes"), "codes")
