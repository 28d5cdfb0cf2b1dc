"""Text decoded with a wrong character encoding: learn the transformations from near-twins, undo them everywhere."""

from __future__ import annotations

import math
import operator
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from encodings.aliases import aliases
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import checked_join
from ..session import spread, stage

#: Words of a window of near-twins, and ASCII letters that make its stripped text telling.
WINDOW, TELLING = 5, 8
#: Of a window without them so many units, at most such a share of them different, have a telling pattern.
UNITS_LEAST, UNITS_SHARE = 16, 0.75
#: A table is learned from so many different windows; one that no encoding explains needs more for each mapping, and so many letters.
VOTES_LEAST, ANONYMOUS_LEAST, LETTERS_LEAST = 3, 12, 3
#: A word is repaired where its log-likelihood gains so much; every transformation besides the first must gain as much as STEP_GAIN.
GAIN_LEAST, STEP_GAIN = 1.0, 2.0
#: What an irregular word loses: case does not show in the pairs.
IRREGULAR = 4.0
#: Tables of single characters count by themselves from this gain on; below it the outcome must be a word so many times as frequent.
GAIN_SURE, FREQUENT = 14.0, 5
#: Character pairs of the language model that are handed to every task; where there are more, those of a word are joined to it.
PAIRS_MOST = 200_000
BROADCAST_ROWS = 200_000
LOST = "\ufffd"
_BLANKS = r"[ \t\r\n\f\x0b]+"
_SPLIT, _HIGH = re.compile(_BLANKS), re.compile(r"[^\x00-\x7f]+")


class Table:
    """A learned transformation.

    ``kind`` is "bytes" where the mappings go from characters to the bytes of UTF-8, "chars" where
    they go from character to character, or the name of a multi-byte encoding whose bytes they are.
    """

    def __init__(self, kind: str, of: dict[str, int | str]):
        one = lambda cs: "[" + re.escape("".join(sorted(cs))) + "]"
        self.kind, self.of = kind, of
        if kind == "chars":
            self.map = {ord(u): c for u, c in of.items()}
            self.outside = re.compile(f"[^\\x00-\\x7f{re.escape(''.join(sorted(of)))}]")
            return
        self.runs = re.compile(one(of) + ("+" if kind == "bytes" else "{2,}"))
        if kind == "bytes":
            two, three, four, more = ([u for u, b in of.items() if low <= b < high] for low, high in ((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5), (0x80, 0xC0)))
            whole = [one(lead) + one(more) * n for n, lead in ((1, two), (2, three), (3, four)) if lead and more]
            self.sequence = re.compile("|".join(whole) or "(?!)")
        else:
            self.outside = re.compile("[A-Za-z]")

    def undo(self, word: str) -> str | None:
        """The word before the transformation; None where it can't have been through it.

        Of UTF-8 whole sequences in a run are enough, as a garbled stretch may begin in a word. In
        tables of characters every one beyond ASCII must have a mapping; in another multi-byte
        encoding a word has no ASCII letter.
        """
        if self.kind == "bytes":
            got = self.sequence.sub(self._utf8, word)
        elif self.outside.search(word):
            return None
        else:
            got = word.translate(self.map) if self.kind == "chars" else self.runs.sub(self._decoded, word)
        return got if got != word else None

    def _utf8(self, m: re.Match) -> str:
        try:
            return bytes(map(self.of.__getitem__, m.group())).decode()
        except UnicodeDecodeError:
            return m.group()

    def _decoded(self, m: re.Match) -> str:
        try:
            return bytes(self.of[c] for c in m.group()).decode(self.kind)
        except UnicodeDecodeError:
            return m.group()

    def whole(self, word: str) -> bool:
        """Whether all the table's characters in a word, and there are some, are UTF-8."""
        runs = self.runs.findall(word)
        try:
            return bool(runs) and all(bytes(self.of[c] for c in run).decode() for run in runs)
        except UnicodeDecodeError:
            return False


@lru_cache(maxsize=1)
def single_bytes() -> dict[str, tuple[str | None, ...]]:
    """The characters of the bytes 128 to 255 in every single-byte encoding Python knows; None for undefined ones and controls."""
    out = {}
    for name in sorted({*aliases.values()}):
        try:
            if bytes(range(32, 127)).decode(name) != "".join(map(chr, range(32, 127))):
                continue
            t = [bytes([b]).decode(name, "replace") for b in range(128, 256)]
        except (LookupError, ValueError, UnicodeError):
            continue
        if all(len(c) == 1 for c in t):
            t = [None if c == LOST or "\x80" <= c < "\xa0" else c for c in t]
            if sum(c is not None for c in t) >= 64:
                out[name] = tuple(t)
    return out


@lru_cache(maxsize=1)
def multi_bytes() -> tuple[str, ...]:
    """Every encoding Python knows, UTF-8 aside, in which two high bytes can be one character, each once."""
    probe, seen = [bytes([a, b]) for a in range(0xB0, 0xF8) for b in range(0xA1, 0xFF)], {}
    for name in sorted({*aliases.values()}):
        try:
            if b"Az".decode(name) == "Az" and len(bytes([0xB0, 0xA1]).decode(name)) == 1:
                seen.setdefault(tuple(p.decode(name, "replace") for p in probe[:: 97]), name)
        except (LookupError, ValueError, UnicodeError):
            continue
    return tuple(sorted(seen.values()))


@lru_cache(maxsize=None)
def names_of(kind: str, u: str, c: str) -> int:
    """The encodings that explain a mapping, as a set of bits.

    For bytes those in which ``c`` is read as ``u``; a byte that is undefined is the control
    character of its number. For characters the pairs of one in which ``c`` was written and one in
    which that byte is read as ``u``.
    """
    known, out = list(single_bytes().values()), 0
    if kind == "bytes":
        b = ord(c) - 128
        for i, t in enumerate(known):
            out |= (t[b] == u or (t[b] is None and u == c)) << i
        return out
    for i, r in enumerate(known):
        for b in (b for b in range(128) if r[b] == u):
            for j, w in enumerate(known):
                out |= (w[b] == c) << (i * len(known) + j)
    return out


def complete(kind: str, of: dict[str, str], names: list[int]) -> dict:
    """The learned mappings with those that all the encodings which explain them agree on."""
    known, more = list(single_bytes().values()), defaultdict(list)
    for n in names:
        r, w = (known[n], None) if kind == "bytes" else (known[n // len(known)], known[n % len(known)])
        for b in range(128):
            if r[b] and (w is None or w[b]):
                more[r[b]].append(chr(b + 128) if w is None else w[b])
    got = {u: v[0] for u, v in more.items() if len(v) == len(names) and len({*v}) == 1} | of
    if kind == "bytes":
        return {chr(b): b for b in range(128, 160)} | {u: ord(c) for u, c in got.items()}
    return got


def _irregular(word: str) -> bool:
    """Whether a word has signs between its letters, or capitals where no word has them."""
    i, j = 0, len(word)
    while i < j and not word[i].isalpha():
        i += 1
    while j > i and not word[j - 1].isalpha():
        j -= 1
    return any(p and not (p.isalpha() and (p.islower() or p.isupper() or p[1:].islower() or p.lower() == p.upper())) for p in _JOINTS.split(word[i:j]))


_JOINTS = re.compile(r"['\u2019\u2010-]")


def _pattern(window: str, k: int) -> str | None:
    """The window with each unit of ``k`` characters beyond ASCII replaced by its number in order of first occurrence."""
    ids: dict[str, str] = {}
    n = 0

    def numbers(m: re.Match) -> str:
        nonlocal n
        run = m.group()
        n += len(run) // k
        return "".join(ids.setdefault(run[i : i + k], chr(256 + len(ids))) for i in range(0, len(run), k))

    if any(len(x) % k for x in _HIGH.findall(window)):
        return None
    got = _HIGH.sub(numbers, window)
    return got if n >= UNITS_LEAST and len(ids) <= UNITS_SHARE * n else None


def _windows(chars: dict[str, int]):
    """Texts to their windows that begin with a word beyond ASCII, each with what is left of it without such characters.

    That is the window with every run of them replaced by one sign; of windows with too little text
    left the pattern of the characters, taken singly and in units of two and three. ``chars`` has
    the count of every character, of which the rarest one's is taken down.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch(b, chars)

    return run


def _batch(b: pa.RecordBatch, chars: dict[str, int]) -> pa.RecordBatch:
    n: Counter = Counter()
    for t in b.column("t").to_pylist():
        words = _SPLIT.split(t)
        high = [i for i, w in enumerate(words[: 1 - WINDOW]) if not w.isascii()]
        for form in {" ".join(words[i : i + WINDOW]) for i in high}:
            if LOST not in form:
                n[form] += 1
    out = []
    for form, k in n.items():
        bare, runs = _HIGH.sub("\x01", form), _HIGH.findall(form)
        row = (sum(map(len, runs)), sum(map(_irregular, form.split(" "))), min(chars.get(c, 0) for r in runs for c in r), k)
        if sum(c.isalpha() for c in bare) >= TELLING:
            out.append((bare, form, 1, *row))
        else:
            out += [(p, form, u, *row) for u in (1, 2, 3) if (p := _pattern(form, u))]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], ["key", "form", "unit", "length", "odd", "rarest", "n"])


def twins(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(form, clean): windows of the texts (t) and the likeliest clean window of the same stripped text.

    Clean is the window with the fewest characters beyond ASCII, then with the fewest irregular
    words, then the most frequent, then the one whose rarest character is the most frequent in the
    words (w, df): a wrong decoding never makes text shorter, and however many copies a garbled
    text has, it stays irregular. Each window is joined to one other, so no group
    of equal windows makes pairs.
    """
    high = texts.where(F.col("t").rlike(r"[^\x00-\x7f]"))
    # one row for each character in use
    seen = words.where(F.col("w").rlike(r"[^\x00-\x7f]")).select("df", F.explode(F.split(F.regexp_replace("w", r"[\x00-\x7f]", ""), "")).alias("c")).groupBy("c").agg(F.sum("df").alias("n"))
    chars = {r["c"]: r["n"] for r in seen.collect()}
    forms = high.mapInArrow(_windows(chars), "key string, form string, unit int, length int, odd int, rarest long, n long").groupBy("key", "form", "unit", "length", "odd", "rarest").agg(F.sum("n").alias("n"))
    forms = stage(forms)
    best = forms.groupBy("key").agg(F.min(F.struct("length", "odd", (-F.col("n")).alias("n"), (-F.col("rarest")).alias("r"), "form", "unit")).alias("b"), F.count("*").alias("forms")).where("forms > 1 and b.unit = 1")
    return checked_join(forms, best.select("key", F.col("b.form").alias("clean")), "key", "form", BROADCAST_ROWS).where("form <> clean").select("form", "clean").distinct()


def aligned(form: str, clean: str) -> set[tuple[str, str, str]]:
    """The mappings (kind, character, byte or character) that make the clean window of the garbled one.

    Runs beyond ASCII stand at the same places in both. Of equal length they map character to
    character, also to itself in a word that differs; a longer garbled run is that of the clean
    run's UTF-8 bytes where these are as many.
    """
    out = set()
    for v, w in zip(form.split(" "), clean.split(" ")):
        for x, y in zip(_HIGH.findall(v), _HIGH.findall(w)) if v != w else ():
            if len(x) == len(y):
                out |= {("chars", u, c) for u, c in zip(x, y)}
            elif len(x) == len(raw := y.encode()):
                out |= {("bytes", u, chr(b)) for u, b in zip(x, raw)}
    return out


def _mappings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Twins to (kind, names, u, c, u2, c2, n): their mappings, with the encodings that explain all of the window's.

    Without any, each mapping comes with its neighbour among those of the window. A row without u
    counts the windows.
    """
    for b in batches:
        n: Counter = Counter()
        for f, c in zip(b.column("form").to_pylist(), b.column("clean").to_pylist()):
            for kind in ("bytes", "chars"):
                own = sorted(m for m in aligned(f, c) if m[0] == kind)
                if own:
                    names = reduce(int.__and__, (names_of(*m) for m in own))
                    n[kind, f"{names:x}", None, None, None, None] += 1
                    n.update((kind, f"{names:x}", *m[1:], *(own[i + 1][1:] if not names and i + 1 < len(own) else (None, None))) for i, m in enumerate(own))
        yield pa.RecordBatch.from_arrays([pa.array([m[j] for m in n], pa.string()) for j in range(6)] + [pa.array(list(n.values()), pa.int64())], ["kind", "names", "u", "c", "u2", "c2", "n"])


def tables(mappings: DataFrame) -> list[Table]:
    """The transformations that the mappings of :func:`_mappings` belong to.

    A character is mapped differently by different transformations, so windows are sorted by the
    encodings that explain all their mappings: those that explain most windows first, which are
    then done with. A table has the mappings learned from its windows, and what its encodings agree
    on besides. Mappings of windows that no encoding explains go into every table in which they
    contradict nothing and stand with another of a window, or begin one. A named table has
    VOTES_LEAST windows, one without a name ANONYMOUS_LEAST for each mapping and LETTERS_LEAST letters.
    """
    # as many rows as there are mappings between characters of the alphabets in use and sets of encodings
    rows = mappings.groupBy("kind", "names", "u", "c", "u2", "c2").agg(F.sum("n").alias("n")).collect()
    windows: dict[tuple[str, int], int] = {}
    seen: dict[tuple[str, int], Counter] = defaultdict(Counter)
    votes: Counter = Counter()
    near: dict[tuple, set] = defaultdict(set)
    for r in rows:
        kind, names = r["kind"], int(r["names"], 16)
        if r["u"] is None:
            windows[kind, names] = r["n"]
        elif names:
            seen[kind, names][r["u"], r["c"]] += r["n"]
        else:
            votes[a := (kind, r["u"], r["c"])] += r["n"]
            if r["u2"] is not None:
                near[a].add(b := (kind, r["u2"], r["c2"]))
                near[b].add(a)
    out = []
    for kind in ("bytes", "chars"):
        left = {names: n for (k, names), n in windows.items() if k == kind and names}
        while left:
            by: Counter = Counter()
            for names, n in left.items():
                for i in range(names.bit_length()):
                    if names >> i & 1:
                        by[i] += n
            most = max(by.values())
            if most < VOTES_LEAST:
                break
            first = min(i for i, n in by.items() if n == most)
            done = [names for names in left if names >> first & 1]
            same = [i for i, n in by.items() if n == most and all(names >> i & 1 for names in done)]
            of: dict[str, str] = {}
            for _, u, c in sorted(((n, u, c) for names in done for (u, c), n in seen[kind, names].items())):
                of[u] = c
            out.append(Table(kind, complete(kind, of, same)))
            for names in done:
                del left[names]
    made: list[tuple[str, dict]] = []
    done: list[tuple] = []
    for a in sorted((a for a, n in votes.items() if n >= ANONYMOUS_LEAST), key=lambda a: (-votes[a], a)):
        kind, u, c = a
        fits = [of for k, of in made if k == kind and of.get(u, c) == c and (u in of or any(of.get(x) == y for _, x, y in near[a]))]
        for of in fits:
            of[u] = c
        if not fits:
            of = {u: c}
            for _, x, y in (b for b in done if b in near[a]):
                of.setdefault(x, y)
            made.append((kind, of))
        done.append(a)
    return out + [Table(kind, complete(kind, of, [])) for kind, of in made if kind == "chars" and sum(c.isalpha() for c in of.values()) >= LETTERS_LEAST]


class _Logs(dict):
    """The log-likelihoods of character pairs, each computed once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, pair: str) -> float:
        m = self.model
        self[pair] = x = math.log((m.pairs.get(pair, 0) + 0.05) / (m.first.get(pair[0], 0) + 0.05 * m.kinds))
        return x


class Model:
    """Character-pair model and the tables; what a task needs to choose among transformations.

    ``first`` has the counts of the pairs by their first character and ``kinds`` the number of
    second characters, both of all pairs; ``pairs`` is None where each word comes with its own.
    """

    def __init__(self, pairs: dict[str, int] | None, first: dict[str, int], kinds: int, made: list[Table]):
        self.joined, self.pairs, self.first, self.kinds, self.tables = pairs is None, pairs or {}, first, max(1, kinds), made
        self.logs = _Logs(self)

    def take(self, b: pa.RecordBatch) -> None:
        """Know the pairs that come with the words of a batch, and no others, where they do."""
        if self.joined:
            self.pairs = {x["c"]: x["n"] for ps in b.column("ps").to_pylist() for x in ps}
            self.logs = _Logs(self)

    def forms(self, word: str) -> Iterator[tuple[str, int, bool, bool]]:
        """The word undone in every way: (form, how often, whether by another table than UTF-8, whether by UTF-8).

        UTF-8 may have been misread any number of times, which makes a word longer each time;
        another transformation is undone once.
        """
        seen, todo = {word}, [(word, 0, False, False)]
        while todo:
            now, steps, other, utf8 = todo.pop()
            for t in self.tables:
                if (other and t.kind != "bytes") or not (got := t.undo(now)) or got in seen:
                    continue
                seen.add(got)
                step = (got, steps + 1, other or t.kind != "bytes", utf8 or t.kind == "bytes")
                todo.append(step)
                if not any("\x80" <= c < "\xa0" for c in got if c not in word):
                    yield step

    def score(self, word: str) -> float:
        return sum(map(self.logs.__getitem__, _pairs(word))) - IRREGULAR * _irregular(word)

    def repair(self, word: str) -> tuple[str, float, bool]:
        """The likeliest original, how much likelier it is, and whether UTF-8 was undone for it."""
        base, best = self.score(word), (0.0, 0.0, word, False)
        for got, steps, _, utf8 in self.forms(word):
            gain = self.score(got) - base
            best = max(best, (gain - STEP_GAIN * (steps - 1), gain, got, utf8))
        return best[2], best[1], best[3]


def _pairs(word: str) -> Iterator[str]:
    s = f" {word.lower()} "
    return map(operator.add, s, s[1:])


def _asked(model: Model, others: list[Table]):
    """Words to the character pairs (w, c) of all that they may be; words that may be nothing else are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w in b.column("w").to_pylist():
                forms = {x[0] for x in model.forms(w)} | {y for t in others if (y := t.undo(w))}
                if forms:
                    out += [(w, c) for c in sorted({c for x in (w, *forms) for c in _pairs(x)})]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.string()), pa.array([c for _, c in out], pa.string())], ["w", "c"])

    return run


def with_pairs(words: DataFrame, model: Model, pairs: DataFrame, others: list[Table] = ()) -> DataFrame:
    """The words (w), and where the model has its pairs joined (w, ps): those that may be others, with the counts of their pairs."""
    if not model.joined:
        return words
    asked = words.mapInArrow(_asked(model, list(others)), "w string, c string")
    return checked_join(asked, pairs, "c", "w", PAIRS_MOST, "left").groupBy("w").agg(F.collect_list(F.struct("c", F.coalesce("n", F.lit(0).cast("long")).alias("n"))).alias("ps"))


def _undone(made: list[Table]):
    """Of the words those that are UTF-8 throughout in one of the tables."""
    byte = [t for t in made if t.kind == "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in b.column("w").to_pylist() if any(t.whole(w) for t in byte)], pa.string())], ["w"])

    return run


def _guess(model: Model, others: list[Table]):
    """Words that no learned table repairs, to the multi-byte encoding that makes them likeliest, and its gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model.take(b)
            out = []
            for x in b.column("w").to_pylist():
                if got := [(y, i) for i, t in enumerate(others) if (y := t.undo(x))]:
                    base = model.score(x)
                    gain, i, y = max((model.score(y) - base, -i, y) for y, i in got)
                    if gain >= GAIN_LEAST and model.repair(x)[1] < GAIN_LEAST:
                        out.append((-i, x, y, gain))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.string(), pa.float64()))], ["i", "w", "back", "gain"])

    return run


def _repair(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model.take(b)
            out = [(w, *model.repair(w)) for w in b.column("w").to_pylist()]
            out = [o for o in out if o[2] >= GAIN_LEAST]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[3] or o[2] >= GAIN_SURE for o in out], pa.bool_())], ["w", "back", "sure"])

    return run


def learn(words: DataFrame, texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model from the distinct texts (t) and their words (w, df), and all character pairs (c, n).

    Windows of the texts are joined with near-twins on the text without characters beyond ASCII,
    the runs of such characters aligned, and the mappings that recur gathered in tables. Words that
    are UTF-8 throughout in such a table are left out of the character pairs, so that garbled text
    can't make its own characters likely. A script without blanks or ASCII has no near-twins: for
    words that no table repairs, the bytes learned from other texts are tried as every multi-byte
    encoding; one is learned where VOTES_LEAST words become much likelier, or much more frequent words.
    """
    made = tables(stage(twins(texts, words).mapInArrow(_mappings, "kind string, names string, u string, c string, u2 string, c2 string, n long")))
    high = spread(words.where(F.col("w").rlike(r"[^\x00-\x7f]") & ~F.col("w").contains(LOST)).select("w"), "w")
    undone = high.mapInArrow(_undone(made), "w string")
    # only words beyond ASCII can be among them
    ascii_words = words.where(~F.col("w").rlike(r"[^\x00-\x7f]")).select("w", "df")
    kept = ascii_words.unionByName(words.where(F.col("w").rlike(r"[^\x00-\x7f]")).select("w", "df").join(undone, "w", "left_anti"))
    padded = kept.select("df", F.concat(F.lit(" "), F.lower("w"), F.lit(" ")).alias("p"))
    two = padded.select("df", F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 1), lambda i: F.substring(F.col("p"), i, F.lit(2)))).alias("c"))
    pairs = stage(two.where(F.length("c") == 2).groupBy("c").agg(F.sum("df").alias("n")))
    # at most one row for each character in use
    first = {r["a"]: r["n"] for r in pairs.groupBy(F.substring("c", 1, 1).alias("a")).agg(F.sum("n").alias("n")).collect()}
    kinds = pairs.select(F.countDistinct(F.substring("c", 2, 1))).first()[0]
    model = Model({r["c"]: r["n"] for r in pairs.collect()} if pairs.count() <= PAIRS_MOST else None, first, kinds, made)
    others = [Table(name, t.of) for t in made if t.kind == "bytes" for name in multi_bytes()]
    if not others:
        return model, pairs
    bare = high.where(F.length(F.regexp_replace("w", "[^A-Za-z]", "")) == 0).select("w")
    tried = stage(with_pairs(bare, model, pairs, others).mapInArrow(_guess(model, others), "i int, w string, back string, gain double"))
    plain = tried.where(F.col("gain") < GAIN_SURE).join(words, "w").join(words.select(F.col("w").alias("back"), F.col("df").alias("df2")), "back").where(F.col("df2") >= FREQUENT * F.col("df"))
    told = tried.where(F.col("gain") >= GAIN_SURE).select("i", "w").unionByName(plain.select("i", "w")).groupBy("i").agg(F.count("*").alias("n"))
    # at most one row for each of the tables tried
    more = [others[r["i"]] for r in told.where(F.col("n") >= VOTES_LEAST).orderBy("i").collect()]
    return Model(None if model.joined else model.pairs, first, kinds, made + more), pairs


def _lost_twins(words: DataFrame) -> DataFrame:
    """(w, back, sure): words with lost characters and the most frequent clean word that fits them.

    A lost character is U+FFFD or a question mark before a letter or between two; the rest of the
    word must be that of a word beyond ASCII with such characters at the same places.
    """
    core = F.regexp_extract("w", r"^[\"'“”(«¿]*(.*?)[.,;:!)\"'“”»]*$", 1)
    gaps = words.where(F.col("w").contains(LOST) | F.col("w").rlike(r"\?+\p{L}|\p{L}\?+\p{L}")).select("w", core.alias("c"))
    gaps = gaps.select("w", F.regexp_replace("c", f"[?{LOST}]", "\u0001").alias("sk"))
    clean = words.where(F.col("w").rlike(r"[^\x00-\x7f]") & ~F.col("w").contains(LOST)).select(core.alias("c"), "df", "rows")
    clean = clean.select(F.regexp_replace("c", r"[^\x00-\x7f]", "\u0001").alias("sk"), "c", "df", "rows").groupBy("sk").agg(F.max_by("c", F.struct("df", "c")).alias("back"), F.sum("rows").alias("seen")).where("seen >= 2")
    return gaps.join(clean, "sk").select("w", "back", F.col("w").rlike(r"\p{L}\?+\p{L}").alias("sure"))


def tokens_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, w): the distinct words of each text, cut at ASCII blanks only: a no-break space may be half a character."""
    return df.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.split(F.col(text), _BLANKS))).alias("w")).where("w <> ''")


def word_repairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, w, back, sure): the garbled words of each text and what they were; back is null where nothing fits."""
    toks = tokens_of(df, key, text)
    # df counts a text once, however many copies of it there are; rows counts every copy
    once = df.groupBy(F.col(text).alias("t")).agg(F.count("*").alias("n"))
    once = stage(once.where("t is not null"))
    words = stage(tokens_of(once, "n", "t").groupBy("w").agg(F.count("*").alias("df"), F.sum("k").alias("rows")))
    model, pairs = learn(words, once.select("t"))
    high = spread(words.where(F.col("w").rlike(r"[^\x00-\x7f]") & ~F.col("w").contains(LOST)).select("w"), "w")
    fixed = stage(with_pairs(high, model, pairs).mapInArrow(_repair(model), "w string, back string, sure boolean"))
    # what a single-byte transformation gives must be a much more frequent word
    held = fixed.where("not sure").join(words, "w").join(words.select(F.col("w").alias("back"), F.col("df").alias("df2")), "back").where(F.col("df2") >= FREQUENT * F.col("df"))
    fixed = fixed.where("sure").unionByName(held.select("w", "back", F.lit(True).alias("sure")))
    lost = words.where(F.col("w").contains(LOST)).select("w").join(_lost_twins(words).select("w", "back"), "w", "left").select("w", "back", F.lit(True).alias("sure"))
    asked = _lost_twins(words).where(~F.col("w").contains(LOST)).select("w", "back", "sure")
    bare = words.where(F.col("w").rlike(r"\?\?") & ~F.col("w").rlike(r"[A-Za-z]")).select("w", F.lit(None).cast("string").alias("back"), F.lit(False).alias("sure"))
    repairs = stage(fixed.unionByName(lost).unionByName(asked).unionByName(bare))
    # plain words, which hold the hot ones, can't be garbled
    asked_of = toks.where(F.col("w").rlike(r"[^\x00-\x7f]|\?"))
    return checked_join(asked_of, repairs, "w", "k", BROADCAST_ROWS).select("k", "w", "back", "sure")


def garbled(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, unsure): the texts that show characters of a wrong decoding.

    A text counts with one word that a learned transformation makes likelier, one U+FFFD or one
    question mark between letters where a known word has a character beyond ASCII, or with three
    words of weaker signs. Null and empty texts never count; rows of one key count as one.
    """
    n = word_repairs(df, key, text).groupBy("k").agg(F.count_if("sure").alias("words"), F.count_if(~F.col("sure")).alias("unsure"))
    return n.where("words > 0 or unsure >= 3").select(F.col("k").alias(key), "words", "unsure")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, ws, bs in zip(*(b.column(c).to_pylist() for c in ("t", "ws", "bs"))):
            known = dict(zip(ws, bs))
            out.append("".join(known.get(p, p) for p in re.split(r"([ \t\r\n\f\x0b]+)", t)))
        yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(out, pa.string())], ["k", "text"])


def restore(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): the garbled texts with their original words, so far as these can be had."""
    r = stage(word_repairs(df, key, text))
    hit = r.groupBy("k").agg(F.count_if("sure").alias("n"), F.count_if(~F.col("sure")).alias("u"), F.collect_list(F.when(F.col("back").isNotNull(), F.struct("w", "back"))).alias("m")).where("n > 0 or u >= 3")
    d = df.select(F.col(key).alias("k"), F.col(text).alias("t")).join(hit, "k").select("k", "t", F.col("m.w").alias("ws"), F.col("m.back").alias("bs"))
    kind = dict(df.dtypes)[key]
    return d.mapInArrow(_rewrite, f"k {kind}, text string").select(F.col("k").alias(key), F.col("text").alias(text))
