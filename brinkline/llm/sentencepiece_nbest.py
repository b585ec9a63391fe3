"""SentencePiece encoding and decoding with N-best segmentation.

A text (blanks written as the piece mark, one put in front) is cut where no
piece can reach across: before the marks of each word.  On the lattice of a
word's pieces the forward Viterbi scores are the exact best costs to come for
a search backward from the word's end, so A-star takes the segmentations off
its agenda in order of score, the N best first.  The N best of the whole text
follow from those of its words, of which only the N - 1 smallest losses
matter.  A character that no piece covers, and a literal piece mark, are
spelt in byte pieces, so decoding gives back every text exactly.

Defined results: null gives null pieces and decodes to null, the empty text
gives none; equal scores go to the segmentation whose last pieces have the
smaller ids; a text with fewer than N segmentations has as many alternatives
as there are; texts are read whole.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

U = np.uint64
MARK = "▁"
CHUNK = re.compile(r" *[^ ]+| +")
BYTE_LOSS = 10.0
UNRANKED = -1e8  # scores below are those of pieces without rank
REMEMBERED = 400_000  # chunks, of about 230 bytes each
SMALL = 20_000
CELLS = 400_000  # arcs of the lattices that are handled at a time (20 bytes each)
PARTS = 50_000  # chunks handled at a time, or those of one text


@dataclass
class Pieces:
    id_of: dict[str, int]  # by piece, with blanks for marks
    score: list[float]
    text: list[bytes]  # what a piece decodes to
    byte_id: list[int]
    longest: int
    unknown: float
    joined: frozenset[str]  # neighbouring characters inside some piece


def load(model_file: str) -> Pieces:
    """Read a model; its pieces may hold marks only in front or alone.  Pieces without rank
    (a score below ``UNRANKED``) count a little less than the last of the ranked ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    id_of, score, text, byte_id = {}, [], [], [0] * 256
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        score.append(model.get_score(i))
        if model.is_byte(i):
            byte_id[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            text.append(b"")
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} reaches across words")
            id_of[piece.replace(MARK, " ")] = i
            text.append(piece.replace(MARK, " ").encode("utf-8"))
    last = min((score[i] for i in id_of.values() if score[i] > UNRANKED), default=0.0)
    score = [s if s > UNRANKED else last - 1.0 for s in score]
    joined = frozenset(piece[k : k + 2] for piece in id_of for k in range(len(piece) - 1))
    return Pieces(id_of, score, text, byte_id, max(map(len, id_of)), last - BYTE_LOSS, joined)


def n_best(p: Pieces, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations of a chunk, best first.

    Blanks stand for marks; a literal mark has no piece.  Forward: for each
    place the arcs that end there, by the best score of a path through them.
    Backward: a hypothesis is an arc and what follows it; taking it off the
    agenda puts on its next best rival and the best arc before it (the newest of equals first).
    """
    size, longest, id_of, score = len(chunk), p.longest, p.id_of, p.score
    into: list[list] = [[] for _ in range(size + 1)]
    best = [0.0] * (size + 1)
    for at in range(size):
        if at:
            into[at].sort(reverse=True)
            best[at] = into[at][0][0]
        here, own = best[at], False
        for end in range(at + 1, min(size, at + longest) + 1):
            i = id_of.get(chunk[at:end])
            if i is not None:
                into[end].append((here + score[i], -i, at, score[i], (i,)))
                own = own or end == at + 1
        if not own:
            spelt = tuple(p.byte_id[b] for b in chunk[at].encode("utf-8", "surrogatepass"))
            into[at + 1].append((here + p.unknown * len(spelt), 0, at, p.unknown * len(spelt), spelt))
    into[size].sort(reverse=True)
    agenda, out, count = [(-into[size][0][0], 0, size, 0, 0.0, None)], [], 0
    while agenda and len(out) < n:
        _, _, end, k, tail, rest = heapq.heappop(agenda)
        arcs = into[end]
        _, _, at, s, ids = arcs[k]
        if k + 1 < len(arcs):
            count -= 1
            heapq.heappush(agenda, (-(arcs[k + 1][0] + tail), count, end, k + 1, tail, rest))
        after = (ids, rest)
        if at:
            count -= 1
            heapq.heappush(agenda, (-(into[at][0][0] + s + tail), count, at, 0, s + tail, after))
        else:
            found = []
            while after is not None:
                found.extend(after[0])
                after = after[1]
            out.append((s + tail, tuple(found)))
    return out


def viterbi(p: Pieces, chunk: str) -> tuple[float, tuple[int, ...], float]:
    """(score, ids, loss of the second best segmentation) of a chunk.

    The second best leaves the best path, seen from the end, at one of its
    places by the next best arc there and follows best arcs before it.
    """
    size, longest, get, score = len(chunk), p.longest, p.id_of.get, p.score
    low = float("-inf")
    best, second, back = [low] * (size + 1), [low] * (size + 1), [(0, 0)] * (size + 1)
    best[0] = 0.0
    for at in range(size):
        here, own = best[at], False
        for end in range(at + 1, min(size, at + longest) + 1):
            i = get(chunk[at:end])
            if i is not None:
                own = own or end == at + 1
                value = here + score[i]
                if value > best[end] or (value == best[end] and i < back[end][1]):
                    second[end], best[end], back[end] = best[end], value, (at, i)
                elif value > second[end]:
                    second[end] = value
        if not own:
            loss = p.unknown * len(chunk[at].encode("utf-8", "surrogatepass"))
            value, end = here + loss, at + 1
            if value >= best[end]:
                second[end], best[end], back[end] = best[end], value, (at, 0)
            elif value > second[end]:
                second[end] = value
    ids, at, loss = [], size, float("inf")
    while at:
        loss = min(loss, best[at] - second[at])
        before, i = back[at]
        ids.append((i,) if i else tuple(p.byte_id[b] for b in chunk[before].encode("utf-8", "surrogatepass")))
        at = before
    return best[size], tuple(x for part in reversed(ids) for x in part), loss


def poly(h: np.ndarray | np.uint64, c: np.ndarray) -> np.ndarray:
    """The hash of a string from that of its front and its last character."""
    return (h ^ (c.astype(U) + U(1))) * U(0x9E3779B97F4A7C15) ^ (c.astype(U) * U(0xD6E8FEB86659FD93))


class Lattice:
    """Viterbi on many short chunks at once, with the results of :func:`viterbi`.

    Pieces are found by a 64-bit hash of every substring in two tables without
    collisions of their own.  (A substring that only shares a piece's hash
    would show when the pieces are decoded.)
    """

    def __init__(self, p: Pieces, bits: int = 19):
        self.p, self.bits = p, bits
        text = list(p.id_of)
        self.ids = np.array([*map(p.id_of.__getitem__, text), -1], np.int64)
        self.score = np.append(np.array(p.score)[self.ids[:-1]], -np.inf)
        code, size = padded(text)
        h = np.zeros(len(text), U)
        for k in range(code.shape[1]):
            h = np.where(size > k, poly(h, code[:, k]), h)
        self.key = np.append(h, U(0))
        self.shift = (64 - bits, 64 - 2 * bits)
        self.first, self.second = (np.full(1 << bits, len(text), np.int32) for _ in range(2))
        place = np.arange(len(text), dtype=np.int32)
        self.first[self.slot(h, 0)] = place
        rest = place[self.first[self.slot(h, 0)] != place]
        self.second[self.slot(h[rest], 1)] = rest
        self.missed = rest[self.second[self.slot(h[rest], 1)] != rest]  # pieces in neither table
        self.longest = int(size.max(initial=1))

    def slot(self, h: np.ndarray, table: int) -> np.ndarray:
        return ((h >> U(self.shift[table])) & U((1 << self.bits) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of the piece with each hash; the last place stands for none."""
        at = self.first[self.slot(h, 0)]
        other = np.flatnonzero(self.key[at] != h)
        at[other] = self.second[self.slot(h[other], 1)]
        at[other[self.key[at[other]] != h[other]]] = len(self.key) - 1
        for k in self.missed:
            at[h == self.key[k]] = k
        return at

    def best(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, loss, pieces one after another, number of pieces) of chunks of like length."""
        code, size = padded(chunks)
        m, width = code.shape
        most = min(self.longest, width)
        none = len(self.key) - 1
        place = np.full((most, m, width), none, np.int32)  # by length - 1 and start
        h = np.zeros((m, width), U)
        for k in range(most):
            inside = np.arange(width - k)[None] + k < size[:, None]
            h = poly(h[:, : width - k], code[:, k:])
            place[k, :, : width - k][inside] = self.find(h[inside])
        spelt = place[0] == none  # one place more than the pieces: the bytes of a character
        bytes_ = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        value, ids = self.score[place], self.ids[place]
        value[0][spelt] = self.p.unknown * bytes_[spelt]
        ids[0][spelt] = 0
        best = np.full((m, width + 1), -np.inf)
        best[:, 0] = 0.0
        gap, back = np.full((m, width + 1), np.inf), np.zeros((m, width + 1), np.int64)
        rows = np.arange(m)
        for end in range(1, width + 1):
            k = np.arange(min(most, end))
            arc = best[:, end - 1 - k] + value[k[:, None], rows, (end - 1 - k)[:, None]].T
            top = arc.max(axis=1)
            own = np.where(arc == top[:, None], ids[k[:, None], rows, (end - 1 - k)[:, None]].T, 1 << 40).argmin(axis=1)
            arc[rows, own] = -np.inf
            best[:, end], back[:, end] = top, own + 1
            with np.errstate(invalid="ignore"):
                gap[:, end] = top - arc.max(axis=1)
        at, loss = size.copy(), np.full(m, np.inf)
        # a spelt character takes as many places as it has bytes
        room = int((size + (spelt * (bytes_ - 1) * (np.arange(width)[None] < size[:, None])).sum(axis=1)).max())
        path, steps = np.zeros((m, room), np.int64), np.zeros(m, np.int64)
        while (live := np.flatnonzero(at)).size:
            here, long_ = at[live], back[live, at[live]]
            loss[live] = np.minimum(loss[live], gap[live, here])
            before = here - long_
            path[live, room - 1 - steps[live]] = ids[long_ - 1, live, before]
            single = np.flatnonzero((long_ == 1) & spelt[live, before])
            steps[live] += 1
            for i, k in zip(live[single].tolist(), before[single].tolist(), strict=True):
                raw = chunks[i][k].encode("utf-8", "surrogatepass")
                end = room + 1 - int(steps[i])
                path[i, end - len(raw) : end] = [self.p.byte_id[b] for b in raw]
                steps[i] += len(raw) - 1
            at[live] = before
        return best[rows, size], loss, path[np.arange(room)[None] >= (room - steps)[:, None]], steps


def padded(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points in rows filled up with 0, lengths)."""
    size = np.fromiter(map(len, chunks), np.int64, len(chunks))
    out = np.zeros((len(chunks), max(1, int(size.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1])[None] < size[:, None]] = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


class Words(dict):
    """Number of each chunk that was met of late; by number its score, pieces, loss of the second best,
    and whether decoding its pieces gives it back.  Bounded by ``most`` chunks and ``4 * most`` pieces:
    when there are more, the less used half and all long chunks are forgotten."""

    def __init__(self, encoder: Encoder, most: int):
        self.encoder, self.most = encoder, most
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.used = np.zeros(0, np.int64)
        self.fresh: list[str] = []
        self.score, self.loss, self.same, self.start, self.flat = np.zeros(0), np.zeros(0), np.zeros(0, bool), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def __missing__(self, text: str) -> int:
        self.fresh.append(text)
        k = self[text] = len(self)
        return k

    def numbers(self, parts: list[str]) -> np.ndarray:
        k = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        if self.fresh:
            score, loss, ids, size = self.encoder.chunks(self.fresh)
            ends, spelling = np.cumsum(size).tolist(), list(map(self.encoder.p.text.__getitem__, ids.tolist()))
            same = [b"".join(spelling[a:b]) == text.encode("utf-8", "surrogatepass") for text, a, b in zip(self.fresh, [0, *ends], ends, strict=False)]
            self.score, self.loss, self.same = np.append(self.score, score), np.append(self.loss, loss), np.append(self.same, same)
            self.start = np.append(self.start, self.start[-1] + np.cumsum(size))
            self.flat = np.append(self.flat, ids.astype(np.int32))
            self.used = np.append(self.used, np.zeros(len(size), np.int64))
            self.fresh = []
        self.used += np.bincount(k, minlength=len(self.used))
        return k

    def pieces(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of the chunks one after another, number of pieces of each)."""
        size = self.start[k + 1] - self.start[k]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[k] - ends + size, size)], size

    def forget(self) -> None:
        if len(self) < self.most and len(self.flat) < 4 * self.most:
            return
        by = sorted((x for x in self.items() if len(x[0]) <= 40), key=lambda x: -self.used[x[1]])[: self.most // 2]
        k = np.array([i for _, i in by], np.int64)
        flat, size = self.pieces(k)
        score, loss, same, used = self.score[k], self.loss[k], self.same[k], self.used[k] // 2
        self.clear()
        self.update((x, i) for i, (x, _) in enumerate(by))
        self.score, self.loss, self.same, self.used = score, loss, same, used
        self.flat, self.start = flat, np.concatenate(([0], np.cumsum(size)))


class Encoder:
    """N-best segmentation of whole texts, words remembered up to a bound."""

    def __init__(self, pieces: Pieces, n: int, remember: int = REMEMBERED):
        self.p, self.n, self.lattice = pieces, n, Lattice(pieces)
        self.words, self.parts, self.others = Words(self, remember), {}, {}

    def cuts(self, text: str):
        """The parts of a chunk between neighbours that no piece holds side by side."""
        joined, at = self.p.joined, 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in joined:
                yield text[at:k]
                at = k
        yield text[at:]

    def chunk(self, text: str) -> tuple[float, tuple[int, ...], float]:
        """(score, ids, loss of the second best) of a chunk."""
        total, ids, loss = 0.0, [], float("inf")
        for part in self.cuts(text):
            own = self.parts.get(part)
            if own is None:
                own = viterbi(self.p, part)
                if len(part) <= 40:
                    if len(self.parts) >= SMALL:
                        self.parts.clear()
                    self.parts[part] = own
            total, loss = total + own[0], min(loss, own[2])
            ids.extend(own[1])
        return total, tuple(ids), loss

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(score, loss, pieces one after another, number of pieces) of chunks; those of like length together."""
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(length, kind="stable")
        score, loss, size = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        ids: list[np.ndarray] = [np.zeros(0, np.int64)]  # in the order of the lengths
        short = int(np.searchsorted(length[order], 40, side="right"))
        at = 0
        while at < short:
            # as many as CELLS arcs allow, by the length of the last one that would fit by the first one's
            much = lambda k: int(length[order[k]]) * min(int(length[order[k]]), self.lattice.longest)
            last = min(short, at + max(1, CELLS // much(at)))
            some = order[at : min(last, at + max(1, CELLS // much(last - 1)))]
            at += len(some)
            score[some], loss[some], flat, size[some] = self.lattice.best([texts[i] for i in some.tolist()])
            ids.append(flat)
        for i in order[short:].tolist():
            score[i], own, loss[i] = self.chunk(texts[i])
            ids.append(np.array(own, np.int64))
            size[i] = len(own)
        start = np.zeros(len(texts), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        ends = np.cumsum(size)
        return score, loss, np.concatenate(ids)[np.arange(size.sum()) + np.repeat(start - ends + size, size)], size

    def rivals(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the other N - 1 best of a chunk, by A-star over its parts."""
        got = self.others.get(text)
        if got is None:
            found = [(0.0, ())]
            for part in self.cuts(text):
                own = n_best(self.p, part, self.n)
                found = sorted(((s + t, a + b) for s, a in found for t, b in own), key=lambda x: -x[0])[: self.n]
            got = [(found[0][0] - s, ids) for s, ids in found[1:]]
            if len(text) <= 40:
                if len(self.others) >= SMALL:
                    self.others.clear()
                self.others[text] = got
        return got

    def encode(self, text: str) -> tuple[list[int], float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """(ids, score, alternatives); an alternative is its score and edits (start, length, ids) of the best ids."""
        ids, _, scores, more, _ = self.batch([text])
        return ids.tolist(), scores[0], more[0]

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[float], list[list], list[bool]]:
        """(pieces of all texts, where each text's start, scores, alternatives, whether decoding gives each text back)."""
        ids, sizes, scores, more, same = [], [], [], [], []
        at = 0
        while at < len(texts):
            parts, ends = [], []
            while at < len(texts) and (not parts or len(parts) < PARTS):
                if texts[at]:
                    parts += CHUNK.findall(" " + texts[at])
                ends.append(len(parts))
                at += 1
            k = self.words.numbers(parts)
            flat, size = self.words.pieces(k)
            ids.append(flat)
            score, loss, fine = self.words.score[k], self.words.loss[k], self.words.same[k]
            lo = 0
            for hi in ends:
                own = np.concatenate(([0], np.cumsum(size[lo:hi])))
                total = float(score[lo:hi].sum())
                sizes.append(int(own[-1]))
                scores.append(total)
                same.append(bool(fine[lo:hi].all()))
                more.append(self.alternatives(total, parts, loss, lo, hi, own))
                lo = hi
            self.words.forget()
        return np.concatenate([*ids, np.zeros(0, np.int32)]), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), scores, more, same

    def alternatives(self, total: float, parts: list[str], loss: np.ndarray, lo: int, hi: int, own: np.ndarray) -> list:
        """The other N - 1 best of a text, from the words with the smallest losses (the first of equals)."""
        own_loss = loss[lo:hi]
        few = min(self.n - 1, hi - lo)
        if few <= 0:
            return []
        near = np.flatnonzero(own_loss <= np.partition(own_loss, few - 1)[few - 1]) if few < hi - lo else np.arange(hi - lo)
        single = []
        for k in near[np.argsort(own_loss[near], kind="stable")][:few].tolist():
            if own_loss[k] < np.inf:
                single += [(lost, k, j, int(own[k]), int(own[k + 1] - own[k]), other) for j, (lost, other) in enumerate(self.rivals(parts[lo + k]))]
        return self.combine(total, sorted(single)[: self.n - 1])

    def combine(self, total: float, single: list) -> list:
        """The best sets of single changes, one for a word at most."""
        out, agenda = [], [(x[0], (i,)) for i, x in enumerate(single)]
        heapq.heapify(agenda)
        while agenda and len(out) < self.n - 1:
            loss, pick = heapq.heappop(agenda)
            out.append((total - loss, [(single[i][3], single[i][4], single[i][5]) for i in sorted(pick, key=lambda i: single[i][3])]))
            for i in range(pick[-1] + 1, len(single)):
                if all(single[i][1] != single[j][1] for j in pick):
                    heapq.heappush(agenda, (loss + single[i][0], (*pick, i)))
        return out


def decoded(p: Pieces, ids: list[int] | tuple[int, ...]) -> bytes:
    """What pieces stand for, one after another; so a text is given back if all its chunks are."""
    return b"".join(map(p.text.__getitem__, ids))


def decode(p: Pieces, ids: list[int] | None) -> str | None:
    return None if ids is None else decoded(p, ids).decode("utf-8", "surrogatepass")[1:]


def apply_edits(ids: list[int], edits: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    out, at = [], 0
    for start, length, other in edits:
        out += ids[at:start]
        out += other
        at = start + length
    return out + ids[at:]


_KEPT: dict[tuple[str, int], Encoder] = {}


def kept_encoder(pieces: Pieces, model_file: str, n: int) -> Encoder:
    """The encoder of this Python worker, which later tasks use again."""
    if (model_file, n) not in _KEPT:
        _KEPT.clear()
        _KEPT[model_file, n] = Encoder(pieces, n)
    return _KEPT[model_file, n]


EDITS = "array<struct<score:double,edits:array<struct<start:int,length:int,ids:array<int>>>>>"


def encode(docs: DataFrame, model_file: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), n: int = 3, reuse: bool = True) -> DataFrame:
    """Columns ``keep`` with ``ids``, ``score``, ``alternatives`` (the other N - 1 best as edits of
    ``ids``) and ``round_trip`` (whether decoding gave back the text).

    ``reuse``: a Python worker keeps its words for later tasks; without it each
    task starts anew with a smaller store and leaves none behind.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load(model_file))
    schema = f"{', '.join(f'`{k}` {docs.schema[k].dataType.simpleString()}' for k in keep)}, ids array<int>, score double, alternatives {EDITS}, round_trip boolean"
    edit = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(edit))]))

    def run(batches):
        p = shared.value
        encoder = kept_encoder(p, model_file, n) if reuse else Encoder(p, n, REMEMBERED // 4)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids, offsets, scores, found, same = encoder.batch([t or "" for t in texts])
            scores = [None if t is None else s for t, s in zip(texts, scores, strict=True)]
            more = [[{"score": s, "edits": [{"start": a, "length": b, "ids": list(c)} for a, b, c in edits]} for s, edits in one] for one in found]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(scores, pa.float64()), pa.array(more, other), pa.array(same)], names=[*keep, "ids", "score", "alternatives", "round_trip"])

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)
