"""Alignment of the tokens of two tokenizers over the same texts.

Both tokenizers cut the bytes of blank + text into tokens.  Tokens of the two
sides that overlap are joined by an edge; the connected components of this
bipartite graph, found by union-find, are exactly the smallest groups that
both sides cut alike.  The members of a component whose byte ranges end
together are linked, and Spark counts over all documents how often a pair of
ids is linked.

Neither tokenizer lets a token reach from a visible character into the blanks
after it (:class:`Aligner` checks the pieces; the pattern of byte-level
tokenizers starts anew there), so a text is cut in front of its words and
words are aligned once while they are remembered.

Only ids of which one's bytes end with the other's can be linked, so the pairs
are bounded by the vocabularies (:func:`most_pairs`) whatever the corpus; the
counts are therefore sent to all executors.

Defined results: null and empty texts, and texts that the joined tokens of a
side do not give back (a literal piece mark, say), have no tokens: zeros, no
links and the empty string as groups.  Special tokens' strings are plain text.
Repeated rows count as often as they are there.  Texts are read whole.
"""

from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, written

MARK = "▁"
WORD = re.compile(r" +[^ ]+(?: +\Z)?")
ODD = re.compile("[^\\S ] |᠎ ")  # blanks that do not follow a visible character
CUT = re.compile("(?<=[^\\s᠎])(?= +[^ ])")
REMEMBERED = 250_000  # words, of about 350 bytes each
LONG = 48  # characters; longer words are aligned where they stand
FRESH = 20_000  # new words aligned at a time, or those of one text


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters for themselves, the others numbered from 256."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def spellings(byte_file: str, piece_file: str) -> tuple[list[bytes], list[bytes]]:
    """What the ids of either side stand for in bytes."""
    import sentencepiece
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(byte_file).get_vocab()
    byte_of = byte_level()
    a = [b""] * (1 + max(vocabulary.values()))
    for token, i in vocabulary.items():
        a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode("utf-8")
    model = sentencepiece.SentencePieceProcessor(model_file=piece_file)
    b = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            b.append(bytes([int(piece[3:5], 16)]))
            continue
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} reaches across words")
        b.append(piece.replace(MARK, " ").encode("utf-8"))
    return a, b


def pieces(piece_file: str) -> int:
    """Size of the B vocabulary."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_file).vocab_size()


def most_pairs(byte_file: str, piece_file: str) -> int:
    """How many pairs of ids can be linked at all: one's bytes are the other's last."""
    a, b = spellings(byte_file, piece_file)
    in_a, in_b = Counter(a), Counter(b)
    return sum(in_b[x[k:]] for x in a for k in range(len(x))) + sum(in_a[x[k:]] for x in b for k in range(1, len(x)))


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each of ``n`` nodes' component: roots of the edges are united under the
    smaller one and paths are halved until no edge joins two roots."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        live = a != b
        u, v, a, b = u[live], v[live], a[live], b[live]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
    return parent


class Numbers(dict):
    """Number of each word; new ones are noted in ``fresh``."""

    def __init__(self, words=()):
        super().__init__(words)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        k = self[word] = len(self)
        return k


class Aligner:
    """Aligns whole texts; words are remembered up to a bound."""

    def __init__(self, byte_file: str, piece_file: str, remember: int = REMEMBERED):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(byte_file), sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.a.encode_special_tokens = True
        self.bytes = spellings(byte_file, piece_file)
        self.size = [np.fromiter(map(len, side), np.int64, len(side)) for side in self.bytes]
        self.remember = remember
        self.number = Numbers()
        self.used = np.zeros(0, np.int64)
        self.counts = np.zeros((0, 4), np.int64)  # of a word: A tokens, B tokens, groups, whether both give it back
        self.text: list[str] = []  # its groups
        self.start, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def parts(self, text: str) -> list[str]:
        text = " " + text
        if ODD.search(text):
            return CUT.split(text)
        return WORD.findall(text) or [text]

    def given_back(self, words: list[str], ids: list[list[int]], side: int) -> np.ndarray:
        spell = self.bytes[side].__getitem__
        return np.fromiter((b"".join(map(spell, own)) == word.encode("utf-8") for word, own in zip(words, ids, strict=True)), bool, len(words))

    def align(self, words: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(counts, groups as text, number of links, pairs of the links one after another) of words."""
        ids = [[e.ids for e in self.a.encode_batch_fast(words, add_special_tokens=False)], self.b.encode([w[1:] for w in words], num_threads=1)]
        fine = self.given_back(words, ids[0], 0) & self.given_back(words, ids[1], 1)
        if not fine.all():
            ids = [[own if ok else [] for own, ok in zip(side, fine.tolist(), strict=True)] for side in ids]
        n = [np.fromiter(map(len, side), np.int64, len(words)) for side in ids]
        flat = [np.fromiter((i for own in side for i in own), np.int64, int(k.sum())) for side, k in zip(ids, n, strict=True)]
        end = [np.cumsum(size[own]) for size, own in zip(self.size, flat, strict=True)]
        begin = end[0] - self.size[0][flat[0]]
        # edges: an A token overlaps the B tokens from the first that ends after its begin to the first that reaches its end
        low, high = np.searchsorted(end[1], begin, side="right"), np.searchsorted(end[1], end[0], side="left")
        width = high - low + 1
        stop = np.cumsum(width)
        u = np.repeat(np.arange(len(begin)), width)
        v = np.arange(stop[-1] if len(stop) else 0) + np.repeat(low - stop + width, width)
        root = components(len(begin) + len(end[1]), u, v + len(begin))
        groups, group = np.unique(root, return_inverse=True)  # an A token is the root of every group
        member = np.concatenate([np.repeat(np.arange(len(words)), k) for k in n])
        # members of a group whose ranges end together
        last = np.flatnonzero(end[1][high] == end[0])
        pairs = flat[0][last] * len(self.bytes[1]) + flat[1][high[last]]
        links = np.bincount(member[last], minlength=len(words))
        per_word = np.bincount(member[groups], minlength=len(words))
        text = self.written_out(np.concatenate(flat), group, np.repeat((0, 1), [len(f) for f in flat]), member, len(words))
        return np.stack([*n, per_word, fine], axis=1).astype(np.int64), text, links, pairs

    @staticmethod
    def written_out(ids: np.ndarray, group: np.ndarray, side: np.ndarray, member: np.ndarray, words: int) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each word."""
        order = np.argsort(2 * group + side, kind="stable")
        ids, group, side, member = ids[order], group[order], side[order], member[order]
        mark = np.full(len(ids), ",", "U1")
        mark[:-1][side[1:] != side[:-1]] = "|"
        mark[:-1][group[1:] != group[:-1]] = ";"
        mark[:-1][member[1:] != member[:-1]] = "\n"
        mark[-1:] = "\n"
        lines = "".join([x for both in zip(map(str, ids.tolist()), mark.tolist(), strict=True) for x in both]).split("\n")
        out = [""] * words
        for k, line in zip(np.unique(member).tolist(), lines, strict=False):
            out[k] = line
        return out

    def learn(self) -> None:
        fresh = self.number.fresh
        for at in range(0, len(fresh), FRESH):
            counts, text, links, pairs = self.align(fresh[at : at + FRESH])
            self.counts = np.concatenate((self.counts, counts))
            self.text += text
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(links)))
            self.links = np.concatenate((self.links, pairs))
        self.used = np.concatenate((self.used, np.zeros(len(fresh), np.int64)))
        fresh.clear()

    def of(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of the links of words one after another, number of links of each)."""
        size = self.start[k + 1] - self.start[k]
        ends = np.cumsum(size)
        return self.links[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[k] - ends + size, size)], size

    def forget(self) -> None:
        """Beyond the bound the less used half and all long words go."""
        if len(self.number) < self.remember and len(self.links) < 4 * self.remember:
            return
        by = sorted((x for x in self.number.items() if len(x[0]) <= LONG), key=lambda x: -self.used[x[1]])[: self.remember // 2]
        k = np.array([i for _, i in by], np.int64)
        self.links, size = self.of(k)
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.counts, self.used, self.text = self.counts[k], self.used[k] // 2, [self.text[i] for i in k.tolist()]
        self.number = Numbers((word, i) for i, (word, _) in enumerate(by))

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(A tokens, B tokens and groups of each text, groups, where each text's links start, pairs)."""
        counts, groups, sizes, pairs = [np.zeros((0, 3), np.int64)], [], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(texts):
            known, ends = [], [0]
            while at < len(texts) and len(self.number.fresh) < FRESH:
                if texts[at]:
                    known += map(self.number.__getitem__, self.parts(texts[at]))
                ends.append(len(known))
                at += 1
            self.learn()
            k, end = np.array(known, np.int64), np.array(ends)
            self.used += np.bincount(k, minlength=len(self.used))
            ahead = lambda x: np.concatenate((np.zeros((1, *x.shape[1:]), np.int64), np.cumsum(x, axis=0)))
            own = np.diff(ahead(self.counts[k])[end], axis=0)
            fine = (own[:, 3] == np.diff(end)) & (np.diff(end) > 0)  # all words are given back
            found, size = self.of(k)
            counts.append(own[:, :3] * fine[:, None])
            sizes.append(np.diff(ahead(size)[end]) * fine)
            pairs.append(found[np.repeat(np.repeat(fine, np.diff(end)), size)])
            groups += [";".join(map(self.text.__getitem__, known[i:j])) if ok else "" for i, j, ok in zip(ends, ends[1:], fine.tolist(), strict=False)]
            self.forget()
        return np.concatenate(counts), groups, np.cumsum(np.concatenate(sizes)), np.concatenate(pairs)


_KEPT: dict[tuple[str, str], Aligner] = {}


def kept_aligner(byte_file: str, piece_file: str) -> Aligner:
    """The aligner of this Python worker, which later tasks use again."""
    if (byte_file, piece_file) not in _KEPT:
        _KEPT.clear()
        _KEPT[byte_file, piece_file] = Aligner(byte_file, piece_file)
    return _KEPT[byte_file, piece_file]


def align(docs: DataFrame, byte_file: str, piece_file: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``n_a``, ``n_b``, ``n_groups``, ``groups`` (ids, as ``a1,a2|b1;a3|b2,b3``)
    and ``links`` (the linked pairs of ids, one number for each, see :func:`pair_ids`)."""
    small_batches(docs.sparkSession)
    schema = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keep) + "n_a long, n_b long, n_groups long, groups string, links array<long>"
    names = [*keep, "n_a", "n_b", "n_groups", "groups", "links"]

    def run(batches):
        aligner = kept_aligner(byte_file, piece_file)
        for batch in batches:
            counts, groups, offsets, pairs = aligner.batch(batch.column(batch.num_columns - 1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(counts[:, i]) for i in range(3)], pa.array(groups, pa.string()), lists], names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(tidy(run), schema)


def pair_ids(pair, pieces: int):
    """(A id, B id) of a pair's number, ``pieces`` being the size of the B vocabulary."""
    return F.floor(pair / F.lit(pieces)).cast("long"), F.pmod(pair, F.lit(pieces)).cast("long")


def pair_counts(found: DataFrame, pieces: int) -> DataFrame:
    """``pair, a, b, n, best`` of all links of a corpus: ``n`` links hold the pair; ``best`` where no
    other A id is linked with the B id more often."""
    pairs = found.select(F.explode("links").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a, b = pair_ids(F.col("pair"), pieces)
    pairs = written(pairs.select("pair", a.alias("a"), b.alias("b"), "n"), "pairs")
    top = pairs.groupBy("b").agg(F.max("n").alias("__top"))
    return pairs.join(top, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("__top")).alias("best"))


def score(found: DataFrame, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``n_links``, ``n_best`` (links whose pair is its B id's most frequent) and
    ``count_sum`` (over the links, of their pairs' counts)."""
    small_batches(found.sparkSession)
    table = counts.select("pair", "n", "best").orderBy("pair").toPandas()  # bounded by the vocabularies
    shared = found.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), table["best"].to_numpy(bool)))
    schema = "".join(f"`{k}` {found.schema[k].dataType.simpleString()}, " for k in keep) + "n_links long, n_best long, count_sum long"

    def run(batches):
        pair, n, best = shared.value
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            first = lists.offsets.to_numpy().astype(np.int64)
            at = np.searchsorted(pair, lists.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]])
            sums = [np.concatenate(([0], np.cumsum(x)))[first - first[0]] for x in (best[at], n[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(np.diff(x).astype(np.int64)) for x in (first, *sums)]], names=[*keep, "n_links", "n_best", "count_sum"])

    return found.select(*keep, "links").mapInArrow(tidy(run), schema)
