"""Toxicity of texts by way of a noisy channel.

A token that may be disguised (letters mixed with digits or symbols, repeated letters, letters that look like others, or letters standing
alone in a row) becomes a lattice: every character may be itself, a letter it imitates, nothing
(a separator or a repetition), or a word break, each at a cost. A Viterbi search under a
character language model finds the likeliest letters. A token of letters that are neither repeated nor look like others has a
lattice of one path and stays. The restored words are scored by what the labels taught about
words and word beginnings.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, distinct_words, fold, release, slices, summed

BREAK = "#"
THRESHOLD = 0.3
#: What a character may stand for.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ѕ": "s", "ј": "j",
    "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ν": "v", "χ": "x", "η": "n", "ı": "i", "ł": "l", "ø": "o", "đ": "d",
}
#: What one star may stand for.
ANY = "abcdefghijklmnopqrstuvwxyz"


def decomposed(c: str) -> str:
    """The base of a character that Unicode composes of a base and marks, or calls a form of another; else itself."""
    return unicodedata.normalize("NFKD", c)[:1].lower() or c


#: Signs beyond ASCII that are forms of a letter or of a sign that imitates one: accents, full width, styled alphabets.
FORMS = [c for c in map(chr, [*range(0xA0, 0x2000), *range(0x2070, 0x2190), *range(0x2460, 0x2500), *range(0xFF00, 0xFFEF), *range(0x1D400, 0x1D800)]) if decomposed(c) != c]
IMITATES |= {c: b if b.isascii() and b.isalpha() else IMITATES[b] for c in FORMS if ((b := decomposed(c)).isascii() and b.isalpha() or b in IMITATES) and c not in IMITATES}
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in IMITATES) + "“”‘’«»…–—¿"
SUBSTITUTED, DROPPED, KEPT_APART, REPEATED, HIDDEN = 0.5, 0.7, 2.0, 0.3, 1.5
#: At least three single characters with white space between them.
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")
TAIL = re.compile(r"(?:!+|\${3,}|\++|\(+)$")
RUN = re.compile(r"(.)\1\1")
#: What the channel can change among letters.
ALIKE = {c: x for c, x in IMITATES.items() if c.isalpha() and len(x) == 1}
OPEN = re.compile(rf"(.)\1|[{''.join(ALIKE)}]")
BASES = str.maketrans(ALIKE)
REPETITION = re.compile(r"(.)\1+")


def numbered(values: np.ndarray) -> np.ndarray:
    """Each value's (0 or more) place among the different ones, ascending; without sorting, unless they are few for their size."""
    top = int(values.max()) + 1
    if top > 4 * len(values) + (1 << 16):
        return np.unique(values, return_inverse=True)[1].astype(np.int64)
    seen = np.zeros(top, bool)
    seen[values] = True
    return (np.cumsum(seen) - 1)[values]


def grams(words: dict[str, int]) -> tuple[list[str], np.ndarray]:
    """The four characters that end at each letter of a word, and at the break after it, with breaks before the
    word; and how often each occurs, if the words occur as often as given."""
    if not words:
        return [], np.zeros(0, np.int64)
    joined = "".join(f"{BREAK * 3}{w}{BREAK}" for w in words)
    codes = numbered(np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64))
    pairs = numbered(codes[:-1] * (codes.max() + 1) + codes[1:])
    which = numbered(pairs[:-2] * (pairs.max() + 1) + pairs[2:])
    first = np.zeros(which.max() + 1, np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    # no window reaches into the next word: the last three starts of each weigh nothing
    weights = np.stack([np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(words), np.int64)], 1).ravel()
    lengths = np.stack([np.fromiter(map(len, words), np.int64, len(words)) + 1, np.full(len(words), 3)], 1).ravel()
    counts = np.zeros(len(first), np.int64)
    np.add.at(counts, which, np.repeat(weights, lengths)[:-3])
    kept = np.flatnonzero(counts)
    return [joined[i : i + 4] for i in first[kept].tolist()], counts[kept]


#: Bits of a character in a packed string.
WIDE = 21
#: Characters, about, that are looked at together.
BLOCK = 1 << 20


@dataclass
class CharacterModel:
    """Letters given up to three before them, interpolated with shorter contexts. The counts of all strings lie in arrays, 20 bytes a
    string: ``contexts`` (packed, ascending, with repetitions), what follows them and how often. ``seen`` holds the contexts looked up."""

    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    follows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    held: dict[str, float] = field(default_factory=dict)
    seen: dict[str, dict[str, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[str, int]) -> CharacterModel:
        rows = [(cls.packed(s[:-1]), ord(s[-1]), n) for s, n in counts.items()]
        return cls.from_arrays(*(np.array([r[k] for r in rows], t) for k, t in enumerate((np.int64, np.int32, np.int64))))

    @classmethod
    def from_arrays(cls, contexts: np.ndarray, follows: np.ndarray, counts: np.ndarray) -> CharacterModel:
        order = np.argsort(contexts, kind="stable")
        return cls(contexts[order], follows[order], counts[order])

    @staticmethod
    def packed(context: str) -> int:
        key = 0
        for c in context:
            key = key << WIDE | ord(c)
        return key

    @property
    def after(self) -> dict[str, dict[str, int]]:
        """By context, the counts of what follows and under "" their sum."""
        names = ["".join(chr(k >> WIDE * i & (1 << WIDE) - 1) for i in (2, 1, 0) if k >> WIDE * i) for k in np.unique(self.contexts).tolist()]
        return {c: self.following(c) for c in names}

    def following(self, context: str) -> dict[str, int]:
        if (found := self.seen.get(context)) is None:
            key = np.int64(self.packed(context))
            at, end = int(self.contexts.searchsorted(key)), int(self.contexts.searchsorted(key, "right"))
            n = self.counts[at:end].tolist()
            found = {"": sum(n)} | dict(zip(map(chr, self.follows[at:end].tolist()), n)) if n else {}
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[context] = found
        return found

    def cost(self, context: str, c: str) -> float:
        """-log of the probability of ``c`` after ``context``, its last three characters."""
        key = context + c
        if (found := self.held.get(key)) is None:
            p = 1e-4
            for k in range(len(context) + 1):
                after = self.following(context[len(context) - k :])
                if after:
                    n, kinds = after[""], len(after)
                    p = (after.get(c, 0) + kinds * p) / (n + kinds)
            if len(self.held) > 1_000_000:
                self.held.clear()
            found = self.held[key] = -math.log(p)
        return found

    def forget(self) -> None:
        self.held.clear()
        self.seen.clear()

    def __getstate__(self):
        return self.__dict__ | {"held": {}, "seen": {}}


def channel(c: str, before: str) -> list[tuple[str, float]]:
    """What ``c`` may come from, and the cost of it."""
    options: list[tuple[str, float]] = []
    if c.isalpha():
        options.append((c, 0.0))
        if c == before:
            options.append(("", REPEATED))
    elif c.isspace():
        return [("", 0.1), (BREAK, KEPT_APART)]
    else:
        options += [("", DROPPED + (1.5 if c.isdigit() else 0)), (BREAK, KEPT_APART)]
    if c == "*" != before:  # of several in a row the first only
        options += [(x, HIDDEN) for x in ANY]
    return options + [(x, SUBSTITUTED) for x in IMITATES.get(c, "")]


def restore(raw: str, model: CharacterModel) -> list[str]:
    """The likeliest words behind ``raw``; linear in its length."""
    beams: dict[str, tuple[float, tuple]] = {BREAK: (0.0, ())}
    before = ""
    for c in raw:
        options, new = channel(c, before), {}
        before = c
        for state, (cost, path) in beams.items():
            for emitted, price in options:
                total = cost + price
                if emitted == "":
                    key, step = state, path
                elif emitted == BREAK:
                    if state != BREAK:
                        total += model.cost(state[-3:], BREAK)
                    key, step = BREAK, (path, " ")
                else:
                    total += model.cost(state[-3:], emitted)
                    key, step = (state + emitted)[-3:], (path, emitted)
                if key not in new or total < new[key][0]:
                    new[key] = (total, step)
        beams = new
    _, path = min(((cost + (0 if s == BREAK else model.cost(s[-3:], BREAK)), p) for s, (cost, p) in beams.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, c = path
        letters.append(c)
    return "".join(reversed(letters)).split()


def bare(token: str) -> str:
    """A token between white space without the punctuation around it."""
    core = token.strip(EDGE)
    return TAIL.sub("", core).strip(EDGE) if core[-1:] in ("!", "$", "+", "(") else core


def words_of(token: str, model: CharacterModel | None) -> list[str]:
    """The words that a token between white space stands for."""
    return words_in(bare(token), model)


def words_in(core: str, model: CharacterModel | None) -> list[str]:
    if core.isalpha() and (model is None or not OPEN.search(core)):
        return [core]
    if not any(map(str.isalpha, core)):
        return []
    if model is None:
        return [w for w in re.split(r"[\W\d_]+", core) if w]
    return restore(core, model)


def squeezed(word: str) -> str:
    """With look-alikes as what they imitate and every run of one letter as one letter: what the channel leaves alike of letters."""
    return REPETITION.sub(r"\1", word if word.isascii() else word.translate(BASES))


def heads(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which cores are words of letters alone, and the first three characters of each core squeezed, a column a character (0: none)."""
    lengths = np.fromiter(map(len, cores), np.int64, len(cores))
    codes = np.frombuffer("".join(cores).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(cores), 3), np.int64)
    if not len(codes):
        return np.zeros(len(cores), bool), out
    present = np.flatnonzero(np.bincount(codes))
    letter, base = np.zeros(present[-1] + 1, bool), np.zeros(present[-1] + 1, np.uint32)
    letter[present] = [chr(c).isalpha() for c in present.tolist()]
    base[present] = [ord(ALIKE.get(chr(c), chr(c))) for c in present.tolist()]
    ends = np.cumsum(lengths)
    letters = (summed(letter[codes], np.append(0, ends)) == lengths) & (lengths > 0)
    least = base[codes]
    new = np.append(True, least[1:] != least[:-1])
    new[(ends - lengths)[lengths > 0]] = True
    until = np.append(0, np.cumsum(new))
    least, first, last = least[new], until[ends - lengths], until[ends]
    for k in range(3):
        own = first + k < last
        out[own, k] = least[first[own] + k]
    return letters, out


def features(word: str) -> list[str]:
    """The word and its beginnings of four to six letters."""
    return [word] + [f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n]


@dataclass
class ToxicityModel:
    letters: CharacterModel
    weights: dict[str, float]
    base: float
    held: dict[str, tuple[str, ...]] = field(default_factory=dict)
    wholes: frozenset[str] = frozenset()
    starts: frozenset[str] = frozenset()
    sizes: tuple[int, ...] = ()
    begins: tuple[np.ndarray, ...] = ()

    def __post_init__(self):
        self.wholes = frozenset(squeezed(f) for f in self.weights if not f.endswith("-"))
        self.starts = frozenset(squeezed(f[:-1]) for f in self.weights if f.endswith("-"))
        self.sizes = tuple(sorted({len(s) for s in self.starts}))
        # by number of characters, up to three, how a word of letters begins that has a feature
        begins = [(3, f) for f in self.wholes] + [(min(3, len(s)), s) for s in self.starts]
        self.begins = tuple(np.array(sorted({CharacterModel.packed(f[:n].ljust(n, "\0")) for m, f in begins if m == n}), np.int64) for n in (1, 2, 3))

    def __getstate__(self):
        return self.__dict__ | {"held": {}}

    @contextmanager
    def remembering(self) -> Iterator[ToxicityModel]:
        """The model for the length of a task: what it remembers of tokens does not stay with the worker."""
        try:
            yield self
        finally:
            self.held.clear()
            self.letters.forget()
            release()

    def known(self, token: str) -> tuple[str, ...]:
        """The learned features in a token."""
        core = bare(token)
        if core.isalpha():
            # the channel drops repetitions and replaces look-alikes here: the word is or begins like a feature, both squeezed, or has none
            if not OPEN.search(core):
                return tuple(f for f in features(core) if f in self.weights)
            least = squeezed(core)
            if least not in self.wholes and not any(least[:n] in self.starts for n in self.sizes):
                return ()
        found = self.held.get(core)
        if found is None:
            found = tuple(f for w in words_in(core, self.letters) for f in features(w) if f in self.weights)
            if len(self.held) > 200_000:
                self.held.clear()
            if len(core) <= 64:
                self.held[core] = found
        return found

    def may_have(self, tokens: list[str]) -> np.ndarray:
        """Which tokens may have a feature: all but the words of letters that, squeezed, begin like none."""
        out = np.zeros(len(tokens), bool)
        cores = list(map(bare, tokens))
        ends = np.cumsum(np.fromiter(map(len, cores), np.int64, len(cores)))
        cuts = np.unique(np.searchsorted(ends, np.arange(BLOCK, ends[-1] if len(ends) else 0, BLOCK), "right")).tolist()
        for at, end in zip([0, *cuts], [*cuts, len(cores)]):
            letters, head = heads(cores[at:end])
            key, like = np.zeros(end - at, np.int64), np.zeros(end - at, bool)
            for k, begins in enumerate(self.begins):
                key = key << WIDE | head[:, k]
                like |= np.isin(key, begins)
            out[at:end] = ~letters | like
        return out

    def found(self, texts: list[str | None]) -> list[set[str]]:
        """The learned features in each text; each different token of the texts is looked at once."""
        low = [t.lower() if t else "" for t in texts]
        parts = pc.utf8_split_whitespace(pa.array(low, pa.string()))
        place, different = distinct_words(parts.values)
        known = {i: own for i in np.flatnonzero(self.may_have(different)).tolist() if (own := self.known(different[i]))}
        has = np.zeros(len(different), bool)
        has[list(known)] = True
        at = np.flatnonzero(has[place])
        out: list[set[str]] = [set() for _ in texts]
        for i, k in zip((np.searchsorted(parts.offsets.to_numpy(), at, "right") - 1).tolist(), place[at].tolist()):
            out[i].update(known[k])
        for t, own in zip(low, out):
            for m in SPACED.finditer(t):
                for w in restore(m[0], self.letters):
                    own.update(f for f in features(w) if f in self.weights)
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability that at least one of the features found is toxic, or the rest's rate."""
        return [min(1.0, max(0.0, 1 - (1 - self.base) * math.prod(1 - self.weights[f] for f in sorted(own)))) for own in self.found(texts)]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def sketch(text: str) -> int:
    """Equal for most near copies: the smallest hash of three words in a row."""
    w = text.encode().split()
    return min((zlib.crc32(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0)


def plain_words(counts: dict[str, int]) -> Counter:
    """The undisguised words among tokens between white space."""
    out: Counter = Counter()
    for token, n in counts.items():
        core = token.strip(EDGE)
        if core.isalpha() and not RUN.search(core):
            out[core] += n
    return out


def letters_of(docs: DataFrame, text: str = "text", most: int | None = None, distinct: int = 100_000) -> CharacterModel:
    """The character model of all texts of ``docs``, with every string counted.

    A task counts tokens, turns every ``distinct`` different ones into strings of four characters, and sends only their
    counts, packed into numbers; shorter contexts are sums of longer ones. ``most``: if given, strings of the rarest powers of two of the
    count are left out where there are over ``most`` in all; no query gives it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            found, n = grams(plain_words(tokens))
            tokens.clear()
            four = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32).reshape(-1, 4).astype(np.int64)
            context = four[:, 0] << 2 * WIDE | four[:, 1] << WIDE | four[:, 2]
            return pa.RecordBatch.from_arrays([pa.array(context), pa.array(four[:, 3].astype(np.int32)), pa.array(n)], ["context", "c", "n"])

        tokens: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                tokens.update((t.as_py() or "").lower().split())
                if len(tokens) > distinct:
                    yield counted()
        yield counted()
        release()

    four = docs.select(F.col(text).alias("text")).mapInArrow(run, "context long, c int, n long").groupBy("context", "c").agg(F.sum("n").alias("n"))
    masks = F.array(*[F.lit((1 << WIDE * k) - 1).cast("long") for k in range(4)])
    ends = four.select(F.explode(F.transform(masks, lambda m: F.col("context").bitwiseAND(m))).alias("context"), "c", "n")
    # strings that begin with two breaks are none
    two = F.lit(ord(BREAK) << WIDE | ord(BREAK)).cast("long")
    ends = ends.where((F.col("context") != two) & (F.shiftright("context", WIDE) != two))
    counts = ends.groupBy("context", "c").agg(F.sum("n").alias("n"))
    rows = counts if most is None else most_frequent(checkpointed(counts), most)
    table = rows.toArrow()
    return CharacterModel.from_arrays(*(table.column(k).to_numpy() for k in ("context", "c", "n")))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of the highest powers of two of ``n``, at most ``most``."""
    floor, total = 0, 0
    for r in sorted(counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            floor = 2 ** (r["power"] + 1)
            break
    return counts.where(F.col("n") >= floor)


def learn(texts: list[tuple[str, int]], letters: CharacterModel, rate: float | None = None) -> ToxicityModel:
    """The model of (text, label) pairs. ``letters``: the model that disguises are read with; ``rate``:
    the rate of label 1 among all labelled rows. Near copies of a toxic text count once. A feature is kept where
    it is far likelier toxic than chance allows over all features tried, and nearly always toxic."""
    toxic: dict[int, str] = {}
    for t, y in sorted(texts):
        if y == 1:
            toxic.setdefault(sketch(t), t)
    clean = sorted(t for t, y in texts if y != 1)
    memo: dict[str, list[str]] = {}

    def parts(text: str) -> set[str]:
        out: set[str] = set()
        for token in set(text.lower().split()):
            if token not in memo:
                memo[token] = [f for w in words_of(token, letters) for f in features(w)]
            out.update(memo[token])
        return out

    hits: Counter = Counter()
    for t in toxic.values():
        hits.update(parts(t))
    hits = Counter({f: n for f, n in hits.items() if n >= 3})
    misses: Counter = Counter()
    memo.clear()
    for t in clean:
        misses.update(f for f in parts(t) if f in hits)
    share = len(toxic) / max(1, len(toxic) + len(clean))
    needed = math.log(len(hits) + 1) + 5
    weights = {}
    for f, n in hits.items():
        m = misses[f]
        p = n / (n + m)
        gain = n * math.log(p / share) + (m * math.log((1 - p) / (1 - share)) if m else 0)
        if p >= 0.95 and gain >= needed:
            weights[f] = (n + 0.5) / (n + m + 1)
    model = ToxicityModel(letters, weights, 0.0)
    missed = sum(not own for own in model.found(list(toxic.values()))) + 0.5
    model.held.clear()
    rate = share if rate is None else rate
    model.base = min(0.25, rate * missed / (len(toxic) + 1))
    return model


def train(docs: DataFrame, labels: DataFrame, where=None, key: str = "doc_id", text: str = "text", label: str = "toxic", most_toxic: int = 1500, most_clean: int = 5000) -> ToxicityModel:
    """The model of at most about ``most_toxic`` and ``most_clean`` labelled rows, taken by the
    hash of their key: the bound on what is broadcast and what reaches the driver. The character model
    counts all texts, labelled or not.

    Rows without text or label teach nothing; a key labelled twice counts as toxic if
    one of its labels says so.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    marks = marks.where(where) if where is not None else marks
    marks = marks.groupBy(key).agg((F.max(label) == 1).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if not counts:
        return learn([], CharacterModel())
    share = F.when(F.col("y") == 1, min(1.0, most_toxic / max(1, counts.get(1, 0)))).otherwise(min(1.0, most_clean / max(1, counts.get(0, 0))))
    sample = marks.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    rows = docs.select(key, text).where(F.col(text).isNotNull()).join(F.broadcast(sample), key).select(text, "y")
    return learn([(t, y) for t, y in map(tuple, rows.collect())], letters_of(docs, text), counts.get(1, 0) / sum(counts.values()))


def scored(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row: 0 to 1, whole texts whatever their length; a null or empty text has the base rate of texts without any
    known feature; repeated rows give repeated results; other columns are not read."""
    frame = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with held.value.remembering() as own:
            for part in (p for b in batches for p in slices(b, 1024)):
                score = own.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], [key, "score"])

    return frame.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns. A null or empty text scores the base rate, at most 0.25, and
    stays; repeated rows are judged alike; an empty table gives none; no other column is read, whatever its name."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with held.value.remembering() as own:
            for part in (p for b in batches for p in slices(b, 1024)):
                yield part.filter(pa.array([x < threshold for x in own.scores(part.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_query(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted: labels are learned outside fold ``held_out`` only."""
    model = train(docs, labels, where=fold("doc_id", folds) != held_out)
    out = F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")
    return scored(docs, model).select("doc_id", out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
