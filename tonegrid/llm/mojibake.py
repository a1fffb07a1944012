"""Text that was decoded with the wrong character encoding (p10)."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.session import discard, materialize

#: The code pages that a text may have been read in, or written in, by their public names.
PAGES = ["cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "iso8859-5", "cp866", "mac_cyrillic", "cp437", "cp850", "cp852", "mac_roman"]
#: Pages of Cyrillic; a swap of two of them turns letters into letters and needs more evidence.
CYRILLIC = {"cp1251", "koi8-r", "iso8859-5", "cp866", "mac_cyrillic"}
#: Rounds of expectation and maximization.
ROUNDS = 3
#: Log odds that a document's windows must give in sum: for UTF-8 read as a code page, for swapped code pages, for two of Cyrillic.
NEEDED = (1.5, 4.0, 10.0)
#: Log odds below the text as it stands at which a reading isn't kept. As no prior is above 1, it could neither be reported nor have a share of 1e-10.
REACH = 25.0
#: The least share of windows that any cipher is taken to have: a floor under what was learned, which rules no cipher out.
RARE = 1e-3
#: Readings of a smaller probability are left out of the expected counts.
SLIGHT = 1e-4
#: The share of a source's windows from which on a cipher is frequent there, so that readings without letters count too.
FREQUENT = 1e-2
SMOOTH = 0.5
#: The least share of a text that is taken to be as it was written, or under one of the ciphers found in it.
LEAST = 0.01
#: Characters of windows and their readings that a task remembers; beyond it they are worked out anew.
HELD = 50_000_000
_RARE = math.log(RARE)

_LETTERS = [bytes([b]) for b in range(256)]
DECODE = {p: [b.decode(p, "ignore") or chr(i) for i, b in enumerate(_LETTERS)] for p in PAGES}  # an unused byte passes as a control character
ENCODE = {p: {c: b for b, c in enumerate(table) if b > 127} for p, table in DECODE.items()}
KNOWN = {c for table in DECODE.values() for c in table} | set(map(chr, range(128)))
#: A run of characters beyond ASCII that some code page has; what no page has, no wrong decoding can have made.
_runs = re.compile("[" + "".join(map(re.escape, sorted(c for c in KNOWN if c > "\x7f"))) + "]+")
_controls = re.compile("[\x80-\x9f]")

Cipher = tuple[str, str]


def swap(wrong: str, right: str) -> dict[int, str]:
    """For translate(): characters read in page `wrong` to those that the same bytes are in page `right`."""
    return {ord(c): DECODE[right][b] for c, b in ENCODE[wrong].items()}


SWAPS = {(right, wrong): swap(wrong, right) for wrong in PAGES for right in PAGES if right != wrong}


def as_utf8(run: str, wrong: str) -> str | None:
    """The run as the UTF-8 that its bytes in page `wrong` are, if they are."""
    codes = ENCODE[wrong]
    try:
        return bytes(ord(c) if c < "\x80" else codes[c] for c in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def undo(text: str, cipher: Cipher) -> str | None:
    """The text with a cipher (right, wrong) undone; None if it can't have come from it."""
    right, wrong = cipher
    if right == "utf-8":
        for page in wrong.split("+"):
            text = as_utf8(text, page)
            if text is None:
                return None
        return text
    return text.translate(SWAPS[cipher])


def candidates(run: str) -> dict[str, Cipher]:
    """What a run of characters beyond ASCII may have been, and by which cipher (right, wrong); UTF-8 may have been misread twice."""
    pages = [p for p in PAGES if all(c < "\x80" or c in ENCODE[p] for c in run)]
    out: dict[str, Cipher] = {}
    for wrong in pages:
        once = as_utf8(run, wrong)
        if once and once != run:
            out.setdefault(once, ("utf-8", wrong))
            for again in sorted({wrong, "cp1252", "latin-1"}):
                twice = as_utf8(once, again)
                if twice and twice != once:
                    out.setdefault(twice, ("utf-8", f"{wrong}+{again}"))
    for wrong in pages:
        for right in PAGES:
            if right != wrong:
                was = run.translate(SWAPS[right, wrong])
                if was != run and not any("\x80" <= c <= "\xa0" for c in was):
                    out.setdefault(was, (right, wrong))
    return out


def windows(text: str) -> list[str]:
    """Each run of characters beyond ASCII, whole, with the character before and after it.

    Between two ciphers or none, only these characters differ in a text, as ASCII is the same in all pages. A run ends at characters that no page has.
    """
    text = f" {text} "
    return [text[m.start() - 1 : m.end() + 1] for m in _runs.finditer(text)]


def _fold(s: str) -> str:
    out = []
    for c in s:
        if c not in KNOWN:
            out.append("" if c.isalpha() else "")  # all characters of no code page are two letters of the alphabet
        elif c.isdigit() and c < "\x80":
            out.append("0")
        elif c <= " ":
            out.append(" ")
        else:
            low = c.lower()
            out.append(low if len(low) == 1 else c)
    return "".join(out)


def _cases(s: str) -> str:
    return "".join("U" if c.isupper() else "L" if c.islower() else "O" for c in s)


class Bigrams:
    """Counts of letter pairs and of case pairs; the alphabet is that of the code pages, so the table is bounded whatever the corpus."""

    def __init__(self, pairs: dict[str, float]):
        self.pairs = pairs
        self.firsts: Counter = Counter()
        for pair, n in pairs.items():
            self.firsts[pair[0]] += n
        self.total = sum(n for c, n in self.firsts.items() if c not in "ULO") or 1.0
        self.memo: dict[str, float] = {}

    @staticmethod
    def of(window: str) -> list[str]:
        low, cases = _fold(window), _cases(window)
        return [low[i : i + 2] for i in range(len(low) - 1)] + [cases[i : i + 2] for i in range(len(cases) - 1)]

    def _pair(self, pair: str) -> float:
        first, second = pair
        if first in "ULO":  # cases; letters are folded
            return math.log((self.pairs.get(pair, 0) + 1) / (self.firsts[first] + 3))
        p = self.pairs.get(pair, 0) + SMOOTH * (self.firsts[second] + 0.1) / self.total
        return math.log(p / (self.firsts[first] + SMOOTH if first >= "\x80" else 1))  # the count of an ASCII neighbour is the same for all

    def __call__(self, window: str) -> float:
        memo, out = self.memo, 0.0
        for pair in self.of(window):
            x = memo.get(pair)
            if x is None:
                x = memo[pair] = self._pair(pair)
            out += x
        return out


class Reader:
    """Weighs, for each window, the ciphers against the text as it stands. Priors: of a source, the log of the share of its windows that each cipher has."""

    def __init__(self, pairs: dict[str, float]):
        self.bigrams = Bigrams(pairs)
        self.seen: dict[str, list[tuple[float, str, Cipher]]] = {}
        self.held = 0

    def options(self, window: str) -> list[tuple[float, str, Cipher]]:
        """(log likelihood ratio to the window itself, the run restored, cipher), of all ciphers within reach."""
        found = self.seen.get(window)
        if found is None:
            plain = self.bigrams(window)
            a, run, b = window[0], window[1:-1], window[-1]
            found = [(self.bigrams(a + was + b) - plain, was, cipher) for was, cipher in candidates(run).items()]
            found = [x for x in found if x[0] > -REACH]
            self.held += 100 + len(window) * (1 + len(found))
            if self.held > HELD:
                self.seen.clear()
                self.held = 0
            self.seen[window] = found
        return found

    def expected(self, priors: dict[str, float], window: str) -> list[tuple[float, str, Cipher | None]]:
        """(probability, window as it was written, cipher) of each reading."""
        odds = [(0.0, window, None)] + [(x + prior(priors, c), window[0] + was + window[-1], c) for x, was, c in self.options(window)]
        most = max(x for x, _, _ in odds)
        weights = [math.exp(x - most) for x, _, _ in odds]
        total = sum(weights)
        return [(w / total, was, c) for w, (_, was, c) in zip(weights, odds) if w > SLIGHT * total]

    def odds(self, window: str, share: dict[Cipher | None, float]) -> list[tuple[float, str, Cipher | None]]:
        """(log odds, run, cipher) of the window as it stands and of its readings under the ciphers of a text."""
        return [(math.log(share[None]), window[1:-1], None)] + [(x + math.log(share[c]), was, c) for x, was, c in self.options(window) if c in share]

    def document(self, priors: dict[str, float], text: str) -> tuple[list[str], str] | None:
        """The ciphers ("right<wrong") found in a text, and the text restored as far as it can be; None if it isn't garbled."""
        gains: dict[Cipher, float] = defaultdict(float)
        for window in set(windows(text)):
            best = max(((x + prior(priors, c), was, c) for x, was, c in self.options(window)), default=None)
            if best and best[0] > 0 and (best[2][0] == "utf-8" or _in_word(window, best[1]) or prior(priors, best[2]) >= math.log(FREQUENT)):
                gains[best[2]] += best[0]
        kinds: Counter = Counter()
        for cipher, gain in gains.items():
            kinds[_kind(cipher)] += gain
        found = {c for c in gains if kinds[_kind(c)] >= NEEDED[_kind(c)]}
        if not found:
            marks = _marks(text, text)
            return (marks, text) if marks else None

        own = Counter(windows(text))
        share = {None: 0.5} | dict.fromkeys(found, 0.5 / len(found))
        for _ in range(ROUNDS + 2):  # how much of this text is under each of its ciphers, learned from the text itself
            sums: dict[Cipher | None, float] = defaultdict(lambda: LEAST)
            for window, n in own.items():
                odds = self.odds(window, share)
                most = max(x for x, _, _ in odds)
                total = sum(math.exp(x - most) for x, _, _ in odds)
                for x, _, c in odds:
                    sums[c] += n * math.exp(x - most) / total
            every = sum(sums[c] for c in share)
            share = {c: max(LEAST, sums[c] / every) for c in share}

        def restored(m: re.Match) -> str:
            window = padded[m.start() - 1 : m.end() + 1]
            ways = [(x + max(0.0, math.log(share[c] / share[None])), c) for x, _, c in self.options(window) if c in share]  # a text that is largely under a cipher speaks for it
            x, cipher = max(ways, key=lambda way: way[0], default=(0.0, None))
            return (undo(m.group(), cipher) or m.group()) if x > 0 else m.group()

        padded = f" {text} "
        mended = _runs.sub(restored, padded)[1:-1]
        return sorted("<".join(c) for c in found) + _marks(text, mended), mended


def prior(priors: dict[str, float], cipher: Cipher) -> float:
    """Log of the share of windows that the source has under the cipher, RARE at least: one window of a rare cipher counts too."""
    return priors.get("<".join(cipher), _RARE)


def _marks(text: str, restored: str) -> list[str]:
    """What shows a garbled text by itself: U+FFFD, and controls U+0080 to U+009F that no cipher restored."""
    return ["lost"] * ("�" in text) + ["control"] * bool(_controls.search(restored))


def _in_word(window: str, was: str) -> bool:
    """Whether a reading has letters, and isn't a character on its own, which might as well be a symbol."""
    return any(c.isalpha() for c in was) and (len(was) > 1 or window[0].isalpha() or window[-1].isalpha())


def _kind(cipher: Cipher) -> int:
    return 0 if cipher[0] == "utf-8" else 2 if set(cipher) <= CYRILLIC else 1


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, ciphers, restored): the rows whose text has at least one character garbled by a wrong decoding.

    A misread text is a substitution cipher: the bytes of one encoding shown as the letters of another. Which of them a source went
    through isn't known, so it is learned by expectation-maximization: the windows around characters beyond ASCII are counted over all
    documents; each round gives every window its probable readings under the bigrams learned so far (expectation), then counts the
    bigrams of those readings, and how often each source used each cipher (maximization). Ciphers are the pairs of known encodings, since a
    single garbled character wouldn't determine a free mapping. Single-byte swaps are undone with translate(), misread UTF-8 by
    encoding and decoding, also when it was misread twice. A text is reported if its windows together speak for a cipher (NEEDED), or if it holds
    U+FFFD, which can't be restored ("lost"), or a control U+0080 to U+009F that no cipher found restores ("control"). A reading without letters counts
    only where its cipher is frequent in the source (FREQUENT). Null, empty and ASCII texts are never reported; repeated rows are each judged; a null source is a source.
    Every source has priors of its own, however many there are: they are a table of a row a source, joined to the windows and documents by source. The
    counts of windows are pre-aggregated in the tasks; only the bigrams, bounded by the alphabet of the code pages, reach the driver.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    d = docs.where(F.col(text).rlike("[^\\x00-\\x7f]")).select(F.col(key).alias("key"), F.col(text).alias("text"), name.alias("source"))

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            by: dict[str, Counter] = defaultdict(Counter)
            for t, b in zip(pdf.text, pdf.source):
                by[b].update(windows(t))
            yield pd.DataFrame([(w, b, n) for b, c in by.items() for w, n in c.items()], columns=["window", "source", "n"])

    counts = d.select("text", "source").mapInPandas(count, "window string, source string, n bigint")
    counts = materialize(counts.groupBy("window", "source").agg(F.sum("n").alias("n")).repartition("window").sortWithinPartitions("window"))

    def with_priors(rows: DataFrame, uses: DataFrame | None) -> DataFrame:
        """Adds `priors`, names and values of the source's priors above the floor."""
        if uses is None:
            return rows.withColumn("priors", F.array().cast("array<struct<c:string,p:double>>"))
        share = F.col("n") / (F.col("total") + 1)
        own = uses.join(uses.groupBy("source").agg(F.sum("n").alias("total")), "source").where((F.col("what") != "") & (share > RARE))
        own = own.groupBy("source").agg(F.collect_list(F.struct(F.col("what").alias("c"), F.log(share).alias("p"))).alias("priors"))  # at most one for each pair of pages
        return rows.join(own, "source", "left")

    def step(pairs: dict[str, float] | None, uses: DataFrame | None) -> tuple[dict[str, float], DataFrame]:
        def expect(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = Reader(pairs) if pairs is not None else None
            sums: Counter = Counter()
            for pdf in it:
                for window, own, n, priors in zip(pdf.window, pdf.source, pdf.n, pdf.priors):
                    for p, was, cipher in reader.expected(_priors(priors), window) if reader else [(1.0, window, None)]:
                        for pair in Bigrams.of(was):
                            sums[None, pair] += n * p
                        sums[own, "<".join(cipher) if cipher else ""] += n * p
                if len(sums) > 1_000_000:
                    yield made(sums)
                    sums = Counter()
            yield made(sums)

        def made(sums: Counter) -> pd.DataFrame:
            return pd.DataFrame([(b, x, float(n)) for (b, x), n in sums.items()], columns=["source", "what", "n"])

        found = with_priors(counts, uses).select("window", "source", "n", "priors").mapInPandas(expect, "source string, what string, n double")
        found = materialize(found.groupBy("source", "what").agg(F.sum("n").alias("n")))
        return {r.what: r.n for r in found.where("source is null").select("what", "n").collect()}, found.where("source is not null")

    pairs, _ = step(None, None)
    uses = None  # nothing is known of the ciphers before the first round
    for _ in range(ROUNDS):
        pairs, uses = step(pairs, uses)
    discard(counts)

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(pairs)
        for pdf in it:
            found = [(k, *x) for k, t, p in zip(pdf.key, pdf.text, pdf.priors) if (x := reader.document(_priors(p), t))]
            yield pd.DataFrame(found, columns=["key", "ciphers", "restored"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, ciphers array<string>, restored string"
    return with_priors(d, uses).select("key", "text", "priors").mapInPandas(judge, schema).withColumnRenamed("key", key)


def _priors(rows) -> dict[str, float]:
    return {} if rows is None else {r["c"]: r["p"] for r in rows}
