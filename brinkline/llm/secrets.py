"""Secret scans: base patterns, plus grammar inference over credential formats.

Labelled credentials of public formats and ordinary long tokens (made here
from a seed) are turned into strings of character classes; those of credentials
are led by a symbol for their length, so that a format of fixed length is known
by it and other lengths fit nothing.  From each set a prefix tree of the whole strings is built and statistically compatible states
are merged (Hoeffding test on a pair of states and on all pairs below it; a
state that fits no other stays one of its own), which gives two probabilistic
automata.  Every candidate token of every whole text is scored by the
log-likelihood ratio of the two per symbol, that of ending there included, and
those above a threshold calibrated on held-out tokens become spans of kind
``format``, whether or not a base span covers them.  A token that fails whole is
also tried without full stops at its end, then part by part between ``=`` and
full stops, then between slashes and plus signs.  Digests in hexadecimal,
UUIDs, numbers, dates, encoded text and short random strings count as ordinary.

Defined results: null and empty texts have no span; spans of all kinds are
ordered by start, then by kind in the order of ``KINDS``; repeated rows are
scanned each by itself; each text is scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run shorter than 18 fails whole, as does every run inside it
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
WORDS = ("password", "passwd", "secret", "token", "api")

#: Character classes, one symbol each; other punctuation stands for itself.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ"}
TO_CLASS = str.maketrans({c: k for k, chars in CLASSES.items() for c in chars})
WITHIN = {k: -math.log(len(chars)) for k, chars in CLASSES.items()}
END = "$"
PARTS = (re.compile(r"[A-Za-z0-9+/_-]{12,}"), re.compile(r"[A-Za-z0-9_-]{12,}"))


def symbols_of(token: str) -> str:
    """The length of a token (one symbol for all from 65 on), then the class of each character."""
    return chr(0x100 + min(len(token), 65)) + token.translate(TO_CLASS)


class Automaton:
    """A probabilistic automaton from a prefix tree whose compatible states are merged."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.count = [{}]
        self.next = [{}]
        for text in strings:
            at = 0
            for c in text + END:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c == END:
                    break
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][c]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _total(self, s: int) -> int:
        return sum(self.count[s].values())

    def _alike(self, a: int, b: int) -> bool:
        """The test on two states and, along the symbols that both have, on all states below.
        ``b`` is the root of a tree, so the walk ends."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            room = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if room >= 1 and m <= 1:
                continue  # nothing below can differ by more
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > room:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _distance(self, a: int, b: int) -> float:
        n, m = max(1, self._total(a)), max(1, self._total(b))
        return sum(abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) for c in self.count[a].keys() | self.count[b].keys())

    def _fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            for c, n in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + n
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    if self.next[a][c] != child:
                        todo.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.next[0])]
        known = {0}
        while blue:
            blue.sort(key=lambda x: -self._total(self.next[x[0]][x[1]]))
            parent, c = blue.pop(0)
            q = self.next[parent][c]
            if q in known:
                continue
            near = [(self._distance(r, q), r) for r in red if self._alike(r, q)]
            if near:
                few = self._total(q) < 30  # too few to tell which of the compatible states is nearest
                target = max((self._total(r), -r, r) for _, r in near)[2] if few else min(near)[1]
                self.next[parent][c] = target
                self._fold(target, q)
            else:
                red.append(q)
                known.add(q)
            blue = [(r, x) for r in red for x in sorted(self.next[r]) if self.next[r][x] not in known]
        self.states = len(red)
        alphabet = len(CLASSES) + 7
        self.log = []
        for s in range(len(self.count)):
            n = self._total(s)
            self.log.append({c: math.log((k + 0.1) / (n + 0.1 * alphabet)) for c, k in self.count[s].items()} | {"": math.log(0.1 / (n + 0.1 * alphabet))} if s in known else None)

    def per_symbol(self, symbols: str) -> float:
        """Mean log-likelihood of a string and its end; symbols never seen restart at the first state."""
        at, total = 0, 0.0
        for c in symbols:
            log = self.log[at]
            total += log.get(c, log[""]) + WITHIN.get(c, 0.0)
            at = self.next[at].get(c, 0)
        return (total + self.log[at].get(END, self.log[at][""])) / (len(symbols) + 1)


def labelled(seed: int = 7, each: int = 120) -> tuple[list[str], list[str]]:
    """Credentials of public formats, and ordinary long tokens."""
    rnd = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    mixed = low + up + dig
    made = (
        lambda: "AKIA" + some(up + dig, 16), lambda: "ghp_" + some(mixed, 36), lambda: f"xoxb-{some(dig, rnd.randint(11, 12))}-{some(dig, rnd.randint(11, 12))}-{some(mixed, 24)}",
        lambda: "AIza" + some(mixed + "_-", 35), lambda: "sk_live_" + some(mixed, 24), lambda: f"eyJ{some(mixed, rnd.randint(17, 60))}.eyJ{some(mixed, rnd.randint(20, 300))}.{some(mixed + '_-', 43)}",
        lambda: some(mixed + "+/", 40), lambda: "glpat-" + some(mixed, 20), lambda: "npm_" + some(mixed, 36),
    )
    low_hex = "0123456789abcdef"
    syllables = "tion ing re con st an er ou le que en de sch ver la al or ed th ment pre un ra mi do ca".split()
    word = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    plain = (
        lambda: word(rnd.randint(5, 10)), lambda: word(rnd.randint(5, 8)).capitalize(), lambda: word(rnd.randint(5, 8)) + rnd.choice(".,"[:1]), lambda: word(5).upper() + ".", lambda: "_".join(word(3) for _ in range(3)), lambda: "-".join(word(3) for _ in range(4)),
        lambda: "".join(word(2).capitalize() for _ in range(4)), lambda: f"www.{word(3)}.example.com/{word(3)}/{word(2)}", lambda: f"{word(4)}.{word(3)}.{rnd.randint(1, 99)}.html",
        lambda: "/".join(word(2) for _ in range(5)), lambda: rnd.choice("=-_.") * rnd.randint(16, 40), lambda: f"20{some(dig, 2)}-0{some(dig, 1)}-1{some(dig, 1)}-{word(4)}",
        lambda: word(6).upper(), lambda: f"{word(3)}={word(2)}{some(dig, 2)}.{word(3)}",
        lambda: "-".join(some(low_hex, n) for n in (8, 4, 4, 4, 12)), lambda: "-".join(some(low_hex, n) for n in (8, 4, 4, 4, 12)).upper(),
        lambda: some(low_hex, rnd.choice((56, 96, 128))), lambda: word(rnd.randint(12, 200)), lambda: "/".join(word(rnd.randint(1, 3)) for _ in range(rnd.randint(4, 40))), lambda: rnd.choice("=-_.") * rnd.randint(41, 500),
        lambda: base64.b64encode(" ".join(word(rnd.randint(1, 3)) for _ in range(rnd.randint(10, 50))).encode()).decode(),
        lambda: some(low_hex, 32), lambda: some(low_hex, 40), lambda: some(low_hex, 64), lambda: some(low_hex, rnd.randint(12, 31)), lambda: some(low_hex, rnd.choice((32, 40, 64))).upper(),
        lambda: some(dig, rnd.randint(12, 24)), lambda: f"{some(dig, rnd.randint(6, 12))}.{some(dig, rnd.randint(5, 12))}", lambda: f"20{some(dig, 6)}T{some(dig, 6)}Z", lambda: f"20{some(dig, 2)}-{some(dig, 2)}-{some(dig, 2)}T{some(dig, 2)}",
        lambda: "-".join(some(dig, rnd.randint(2, 5)) for _ in range(4)), lambda: base64.b64encode(" ".join(word(rnd.randint(1, 3)) for _ in range(rnd.randint(2, 14))).encode()).decode(),
        lambda: some(mixed, rnd.randint(12, 32)), lambda: some(low + dig, rnd.randint(12, 32)), lambda: some(up + dig, rnd.randint(12, 32)),
    )
    return [f() for f in made for _ in range(each)], [f() for f in plain for _ in range(each)]


@dataclass(frozen=True)
class SecretModel:
    secret: Automaton
    plain: Automaton
    threshold: float

    def ratio(self, token: str) -> float:
        return self._ratio(symbols_of(token))

    def _ratio(self, symbols: str) -> float:
        return self.secret.per_symbol(symbols) - self.plain.per_symbol(symbols[1:])


@lru_cache(maxsize=1)
def fit(seed: int = 7, each: int = 120, false_rate: float = 0.002) -> SecretModel:
    """``2 * each`` tokens of a format are made; odd ones are held out to set the
    threshold, which at most ``false_rate`` of the ordinary held-out tokens pass."""
    yes, no = labelled(seed, 2 * each)
    model = SecretModel(Automaton([symbols_of(x) for x in yes[::2]]), Automaton([symbols_of(x)[1:] for x in no[::2]]), 0.0)
    bad = sorted(model.ratio(x) for x in no[1::2])
    cut = bad[min(len(bad) - 1, int(len(bad) * (1 - false_rate)))]
    good = sorted(model.ratio(x) for x in yes[1::2])
    return SecretModel(model.secret, model.plain, max(cut, (cut + good[len(good) // 20]) / 2) + 1e-9)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three base patterns."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, model: SecretModel, base: list[tuple[int, int, int]], seen: dict[str, float]) -> list[tuple[int, int, int]]:
    def passes(token: str) -> bool:
        symbols = symbols_of(token)
        score = seen.get(symbols)
        if score is None:
            score = model._ratio(symbols)
            if len(symbols) <= 64:
                if len(seen) >= 50_000:
                    seen.clear()
                seen[symbols] = score
        return score > model.threshold

    more = []
    for m in TOKEN.finditer(text):
        token, at = m[0], m.start()
        bare = token.rstrip(".")
        if passes(token):
            more.append((at, 3, m.end()))
        elif len(bare) < len(token) and len(bare) >= 12 and passes(bare):
            more.append((at, 3, at + len(bare)))
        else:
            for part in PARTS:
                found = [(at + p.start(), 3, at + p.end()) for p in part.finditer(token) if len(p[0]) < len(token) and passes(p[0])]
                if found:
                    more += found
                    break
    return sorted(base + more) if more else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: SecretModel | None = None) -> DataFrame:
    """One row per input row: the id and ``base`` and ``spans`` as arrays of
    ``struct<kind, start, end>`` in code points, end exclusive."""
    small_batches(docs.sparkSession)
    model = model or fit()
    kind = "array<struct<kind:string,start:int,`end`:int>>"
    to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, base {kind}, spans {kind}"
    rows = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

    def run(batches):
        seen: dict[str, float] = {}
        for batch in batches:
            base, full = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text or "")
                base.append(rows(found))
                full.append(rows(all_spans(text or "", model, found, seen)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, to), pa.array(full, to)], names=[id_col, "base", "spans"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
