"""Secret scan: candidates by pattern, false positives removed by a random forest trained on labelled findings.

Candidates are key blocks, web tokens, passwords of URLs, values assigned to a name that says secret, and long runs of the
characters that keys are made of. Features: length, shares and changes of character classes, likelihood of the character
transitions under those of ordinary words, entropy, share of the characters covered by dictionary words, what the path
says (tests, samples, documents), what introduces the value, and the neighbouring words. Transitions and the dictionary
are counted over all documents (``learn_language``), so they follow the corpus.

The forest is fitted on the driver on at most ``ROWS`` findings; texts are scanned whole and where they lie.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyflow.llm.common import materialize, released
from keyflow.llm.words import slices

#: Labelled findings that the forest is fitted on at most, its trees, their depth, and words on either side of a candidate.
ROWS = 6000
TREES = 25
DEPTH = 9
CONTEXT = 5
#: The dictionary's words at most (the most frequent), their least length and the rows they must be in at least.
DICTIONARY = 200_000
_SHORT = 4
_OFTEN = 2
# Shapes of secrets and of what introduces them.
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----(?:(?!-----)[\s\S])*(?:-----END [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----)?")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]*)?")
_URL = re.compile(r"[a-z][a-z0-9+.-]*://[^\s:/@\"'<>]*:([^\s/@\"'<>]{3,})@", re.I)
_ASSIGNED = re.compile(
    r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|credentials?)[\w.-]*+[\"']?\s{0,3}(?:=>|:=|=|:|\bis\b)\s{0,3}(?:(?:bearer|basic)\s+)?"
    r"(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|[\"']?([^\s\"',;<>]{6,}))",
    re.I,
)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_LETTERS = re.compile(r"[a-z]+")
_WORDS = re.compile(r"[^\W\d_]+")
_KNOWN = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|pk_live_|SG\.|eyJ|npm_|hf_|ya29\.|-----BEGIN)")
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
_SEPARATOR = re.compile(r"(?:=>|:=|=|:)\s*(?:(?:bearer|basic)\s+)?[\"']?$", re.I)
_NAME = re.compile(r"([A-Za-z][\w.-]*)[\"']?\s*(?:=>|:=|=|:|\bis\b)?\s*(?:(?:bearer|basic)\s+)?[\"']?$", re.I)
_USER = re.compile(r"://[^\s:/@]*:$")
_KEY_NAME = re.compile(r"passw(?:or)?d|api_?key", re.I)
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_DATA = re.compile(r"(?:base64,|sha\d+-|integrity=\S*|data:\S*)$", re.I)
# Words beside a value that say what it is, and parts of paths.
_KEY_WORDS = frozenset("token secret key apikey api password passwd passphrase pwd auth authorization bearer credential credentials private access client aws signing".split())
_DIGEST_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest hash revision rev etag uuid guid id order invoice isbn card account number phone tracking".split())
_SAMPLE_WORDS = frozenset("example sample dummy fake placeholder test your changeme demo xxxx".split())
_PATH_WORDS = frozenset("test tests example examples sample samples doc docs fixture fixtures mock demo".split())


@dataclass
class Candidate:
    start: int
    end: int
    value: str
    before: str
    after: str


def _beside(text: str, at: int, step: int) -> str:
    """What stands before (step -1) or after (1) a place, with ``CONTEXT`` whole words at least, or to the text's end."""
    n = 120
    while True:
        part = text[max(0, at - n) : at] if step < 0 else text[at : at + n]
        if len(part) < n or len(_WORDS.findall(part)) > CONTEXT:
            return part
        n *= 2


def candidates(text: str | None) -> list[Candidate]:
    """Candidates of a text, by their start, none overlapping: key blocks, then web tokens, passwords of URLs and assigned
    values; a run that one of them touches is no candidate of its own. An assigned value takes in a web token in it."""
    if not text:
        return []
    spans = [m.span() for m in _BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    assigned = [m.span(m.lastindex) for m in _ASSIGNED.finditer(text)]
    if "eyJ" in text:
        spans += [m.span() for m in _TOKEN.finditer(text)]
    if "://" in text:
        spans += [m.span(1) for m in _URL.finditer(text)]
    strong = len(spans)
    spans += assigned
    spans += [m.span() for m in _RUN.finditer(text) if any(c.isdigit() for c in m[0]) or (not m[0].islower() and not m[0].isupper() and _mixed(m[0]))]
    taken: list[tuple[int, int]] = []
    for rank in (spans[:strong], spans[strong : strong + len(assigned)], spans[strong + len(assigned) :]):
        kept = sorted(taken)
        begins = [a for a, _ in kept]
        last = -1
        for a, b in sorted(set(rank), key=lambda s: (s[0], -s[1])):
            i = int(np.searchsorted(begins, b)) if begins else 0
            if a >= last and not (i and kept[i - 1][1] > a):
                taken.append((a, b))
                last = b
    return [Candidate(a, b, text[a:b], _beside(text, a, -1), _beside(text, b, 1)) for a, b in sorted(taken)]


def _mixed(value: str) -> bool:
    """Whether a run of letters changes case as a random one does, unlike names made of words."""
    return sum(a.islower() and b.isupper() or a.isupper() and b.isupper() for a, b in zip(value, value[1:], strict=False)) * 5 >= len(value)


_CLASSES = {ord(c): i for i, group in enumerate(("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in group}


@dataclass
class Language:
    """Ordinary words: log likelihood of character pairs, and the dictionary with the longest word of each beginning."""

    pairs: dict[str, float]
    least: float
    dictionary: frozenset[str]
    longest: dict[str, int]

    def transitions(self, value: str) -> float:
        low, get, least = value.lower(), self.pairs.get, self.least
        return sum(get(a + b, least) for a, b in zip(low, low[1:], strict=False)) / max(1, len(low) - 1)

    def covered(self, value: str) -> float:
        """Share of the characters in dictionary words of 4 letters or more, the longest first from the left."""
        total = 0
        for run in _LETTERS.findall(value.lower()):
            i = 0
            while i + _SHORT <= len(run):
                most = min(self.longest.get(run[i : i + _SHORT], 0), len(run) - i)
                n = next((n for n in range(most, _SHORT - 1, -1) if run[i : i + n] in self.dictionary), 0)
                total += n
                i += n or 1
        return total / max(1, len(value))


def language_of(words: dict[str, int], pairs: dict[str, int] | None = None) -> Language:
    """From counts of words; ``pairs``: counts of their character pairs, by default of these words."""
    if pairs is None:
        pairs = Counter()
        for w, n in words.items():
            for a, b in zip(w, w[1:], strict=False):
                pairs[a + b] += n
    first: Counter = Counter()
    for p, n in pairs.items():
        first[p[0]] += n
    table = {p: math.log((n + 0.1) / (first[p[0]] + 4)) for p, n in pairs.items()}
    dictionary = frozenset(w for w in words if len(w) >= _SHORT)
    longest: dict[str, int] = {}
    for w in dictionary:
        longest[w[:_SHORT]] = max(longest.get(w[:_SHORT], 0), len(w))
    return Language(table, math.log(0.001), dictionary, longest)


def learn_language(docs: DataFrame, text_column: str = "text", most: int = DICTIONARY) -> Language:
    """Dictionary and transitions of all words of a to z in all documents, upper case as lower. The dictionary has words of
    ``_SHORT`` letters or more that come twice or more, the ``most`` most frequent; pairs are counted over all words. The
    driver holds that many words and 676 pairs."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_column)), "[^a-z]+")).alias("word")).where(F.length("word") > 1)
    counted = materialize(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i")
    pairs = counted.select("word", "n", at).groupBy(F.expr("substring(word, i, 2)").alias("pair")).agg(F.sum("n").alias("n"))
    long = counted.where((F.length("word") >= _SHORT) & (F.col("n") >= _OFTEN))
    total, least = long.count(), 0
    if total > most:  # so that few more than are taken meet to be sorted
        least = long.agg(F.percentile_approx("n", 1.0 - most / total, 10_000)).first()[0]
    kept = materialize(long.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most), "dictionary")  # chosen on the executors
    return language_of({r.word: r.n for r in kept.collect()}, {r.pair: r.n for r in pairs.collect()})


def features(value: str, before: str, after: str, path: str | None, language: Language) -> list[float]:
    n = len(value)
    counts = Counter(value)
    classes = [_CLASSES.get(ord(c), 3) for c in value]
    left = [w.lower() for w in _WORDS.findall(before)][-CONTEXT:]
    right = [w.lower() for w in _WORDS.findall(after)][:CONTEXT]
    near = set(left) | set(right)
    parts = set(re.split(r"[^a-z0-9]+", (path or "").lower()))
    named = _NAME.search(before.rpartition("\n")[2])
    keyed = bool(_KEY_WORDS.intersection(p.lower() for p in _NAME_PART.findall(named[1])) or _KEY_NAME.search(named[1])) if named else False
    in_url = bool(_USER.search(before)) and after.startswith("@")
    name = [p.lower() for p in _NAME_PART.findall(named[1])] if named else []
    return [
        math.log(n),
        sum(c == 0 for c in classes) / n,
        sum(c == 2 for c in classes) / n,
        sum(c == 3 for c in classes) / n,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / max(1, n - 1),
        language.transitions(value),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        len(counts) / n,
        language.covered(value),
        float(bool(_UUID.fullmatch(value))),
        float(bool(parts & _PATH_WORDS)),
        float(len(near & _KEY_WORDS)),
        float(len(near & _DIGEST_WORDS)),
        float(bool(near & _SAMPLE_WORDS) or any(w in value.lower() for w in ("example", "xxxx", "your", "placeholder", "changeme"))),
        float(bool(_SEPARATOR.search(before))),
        float(keyed or in_url),
        float(before.endswith(('"', "'"))),
        float(bool(_DIGEST_WORDS.intersection(name))),
        float(bool(_KNOWN.match(value))),
        float(bool(_DATA.search(before))),
        sum(w in language.dictionary for w in near) / max(1, len(near)),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (below 0 for a leaf), limit, children, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def chance(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, limit, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[node]
                at = np.flatnonzero(f >= 0)
                if not len(at):
                    break
                low = x[at, f[at]] <= limit[node[at]]
                node[at] = np.where(low, left[node[at]], right[node[at]])
            total += share[node]
        return total / max(1, len(self.trees))


def fit_forest(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Forest:
    """Random forest by Gini impurity: bootstrap rows for a tree, a random half of the features for a split."""
    rng = np.random.RandomState(seed)
    tried = max(1, x.shape[1] // 2)
    trees = []
    for _ in range(TREES):
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, depth: int, nodes=nodes) -> int:
            me = len(nodes)
            share = float(y[rows].mean()) if len(rows) else 0.0
            nodes.append([-1, 0.0, 0, 0, share])
            if depth >= DEPTH or len(rows) < 4 or share in (0.0, 1.0):
                return me
            best = (1e-9, -1, 0.0)
            whole = 2 * share * (1 - share)
            for f in rng.permutation(x.shape[1])[:tried]:
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, t = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                nl = cut + 1.0
                nr = len(rows) - nl
                pl, pr = t[cut] / nl, (t[-1] - t[cut]) / nr
                gain = whole - (nl * 2 * pl * (1 - pl) + nr * 2 * pr * (1 - pr)) / len(rows)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
            if best[1] < 0:
                return me
            low = x[rows, best[1]] <= best[2]
            nodes[me][:2] = [best[1], best[2]]
            nodes[me][2] = grow(rows[low], depth + 1)
            nodes[me][3] = grow(rows[~low], depth + 1)
            return me

        grow(rng.randint(0, len(x), len(x)), 0)
        a = np.array(nodes)
        trees.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return Forest(trees)


@dataclass
class Scanner:
    language: Language
    forest: Forest
    limit: float = 0.5

    def chances(self, found: list[tuple[Candidate, str | None]]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        return self.forest.chance(np.array([features(c.value, c.before, c.after, path, self.language) for c, path in found]))


FINDINGS = "kind string, value string, before string, after string, path string, label int"


def train(findings: DataFrame, language: Language | None = None, rows: int = ROWS) -> Scanner:
    """Fit on at most ``rows`` labelled findings (value, before, after, path, label), the smallest hashes of their values.
    Findings without a value or label aren't used; null texts are empty. Without both labels everything stays a finding.
    Without a language that of the words beside the findings is learnt."""
    used = findings.where("value is not null and value != '' and label is not null").select("value", "before", "after", "path", "label")
    got = used.orderBy(F.xxhash64("value", "before", "after"), "value", "before", "after", "path", "label").limit(rows).collect()
    if language is None:
        language = language_of(Counter(w.lower() for r in got for w in [*_WORDS.findall(r.before or ""), *_WORDS.findall(r.after or "")]))
    y = np.array([float(r.label) for r in got])
    if not 0 < y.sum() < len(y):
        return Scanner(language, Forest([]), -1.0)
    x = np.array([features(r.value, r.before or "", r.after or "", r.path, language) for r in got])
    return Scanner(language, fit_forest(x, y))


def scan(docs: DataFrame, scanner: Scanner, id_column: str = "doc_id", text_column: str = "text", path_column: str | None = None) -> DataFrame:
    """(doc_id, start, end, value, chance, is_secret): a row for each candidate of each row of ``docs``, places in code
    points, the chance rounded to 6 digits. Null texts have none; ids may be null or repeat; empty tables give an empty
    result. Other columns are not read."""
    path = F.col(path_column).cast("string") if path_column else F.lit(None).cast("string")
    frame = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), path.alias("path"))
    names = ["doc_id", "start", "end", "value", "chance", "is_secret"]
    sent = docs.sparkSession.sparkContext.broadcast(scanner)  # DICTIONARY words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        for batch in batches:
            for some in slices(batch, "text"):
                rows, found = [], []
                for r, (text, path) in enumerate(zip(some.column("text").to_pylist(), some.column("path").to_pylist(), strict=True)):
                    for c in candidates(text):
                        rows.append(r)
                        found.append((c, path))
                p = scanner.chances(found)
                ids = some.column("doc_id").take(pa.array(rows, pa.int64()))
                cells = [pa.array([getattr(c, x) for c, _ in found], t) for x, t in (("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()))]
                yield pa.record_batch([ids, *cells, pa.array(np.round(p, 6), pa.float64()), pa.array(p >= scanner.limit, pa.bool_())], names=names)

    kind = dict(frame.dtypes)["doc_id"]
    return frame.mapInArrow(released(run), f"doc_id {kind}, start long, end long, value string, chance double, is_secret boolean")


_HEX, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Words for findings made by rule where no language is given.
_PLAIN = "account archive backup branch buffer cache change channel client column commit config configuration copy count custom data database default delete device document download error event export field file filter folder format group handler history image import index input item label language level list load local machine manager master memory message method model module name network number object option order output package page parameter parent path pattern process product profile project property query queue random range read record release remote report request reset resource response result route sample schema script search section select server service session setting shape signal simple size source space stage state status storage stream string style submit system table target task template thread time title token update upload user value version view window worker write".split()


class _Maker:
    """Findings made by rule. Each kind is a method that gives (value, before, after) of one finding."""

    def __init__(self, seed: int, words: list[str]):
        self.rng, self.words = random.Random(seed), words

    def some(self, alphabet: str, n: int) -> str:
        return "".join(self.rng.choice(alphabet) for _ in range(n))

    def word(self) -> str:
        return self.rng.choice(self.words)

    def prose(self, least: int = 0) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, 8)))

    def name(self, of: tuple[str, ...]) -> str:
        base = self.rng.choice(of)
        shape = self.rng.randrange(4)
        return (base, base.upper(), f"{self.word()}_{base}", f"{self.word().upper()}_{base.upper()}")[shape]

    def after_name(self, name: str) -> tuple[str, str]:
        """(before, after) of an assigned value, as in code, settings, JSON, shells and prose."""
        q = self.rng.choice("\"'")
        return self.rng.choice([
            (f"{self.prose()}\n{name} = {q}", f"{q}\n{self.prose()}"), (f"{self.prose()}\n{name}: ", f"\n{self.prose()}"), (f"{self.prose()}\nexport {name}=", f"\n{self.prose()}"),
            (f'{{"{self.word()}": 1, "{name}": "', f'", "{self.word()}": 2}}'), (f"{self.prose(1)} {name} = {q}", f"{q} {self.prose()}"), (f"{self.prose(1)}. The {name} is ", f" {self.prose(1)}"),
        ])

    def plain(self) -> tuple[str, str]:
        return self.rng.choice([(f"{self.prose(2)} ", f" {self.prose(2)}"), (f"{self.prose(1)}\n", f"\n{self.prose(1)}"), (f"{self.prose(1)}: ", f"\n{self.prose()}"), (f"({self.prose(1)} ", f") {self.prose()}")])

    KEYS = ("token", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret", "secret_key", "access_token", "private_key", "signing_key")
    PASSWORDS = ("password", "passwd", "db_password", "pwd", "passphrase", "admin_password")

    # Secrets.
    def hex_key(self):
        value = self.some(_HEX, self.rng.choice([32, 40, 48, 64]))
        return (value if self.rng.random() < 0.8 else value.upper(), *self.after_name(self.name(self.KEYS)))

    def random_key(self):
        return (self.some(_ALNUM + self.rng.choice(["", "+/", "-_"]), self.rng.randint(20, 64)), *self.after_name(self.name(self.KEYS)))

    def provider_key(self):
        value = self.rng.choice([
            "AKIA" + self.some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + self.some(_ALNUM, 36), "glpat-" + self.some(_ALNUM + "-_", 20), "sk_live_" + self.some(_ALNUM, 24),
            "xoxb-" + self.some("0123456789", 12) + "-" + self.some("0123456789", 12) + "-" + self.some(_ALNUM, 24), "AIza" + self.some(_ALNUM + "-_", 35), "hf_" + self.some(_ALNUM, 34), "npm_" + self.some(_ALNUM, 36),
        ])
        return (value, *(self.plain() if self.rng.random() < 0.6 else self.after_name(self.name(self.KEYS))))

    def web_token(self):
        value = "eyJ" + self.some(_ALNUM, self.rng.randint(17, 33)) + ".eyJ" + self.some(_ALNUM, self.rng.randint(30, 120)) + "." + self.some(_ALNUM + "-_", 43)
        return (value, *self.rng.choice([self.plain(), self.after_name("token"), (f"{self.prose()}\nAuthorization: Bearer ", f"\n{self.prose()}")]))

    def url_password(self):
        value = self.rng.choice([self.some(_ALNUM, self.rng.randint(8, 24)), self.word() + self.some("0123456789", 3), self.word(), self.word().title() + "!" + self.some("0123456789", 2)])
        scheme = self.rng.choice(["postgres", "mysql", "https", "mongodb", "redis", "amqp", "ftp"])
        return value, f"{self.prose()} {scheme}://{self.rng.choice(['', self.word(), 'root'])}:", f"@{self.word()}.{self.word()}.org/{self.word()} {self.prose()}"

    def key_block(self):
        kind = self.rng.choice(["RSA ", "EC ", "OPENSSH ", ""])
        lines = "\n".join(self.some(_ALNUM + "+/", 64) for _ in range(self.rng.randint(3, 20)))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----", *self.plain()

    def word_password(self):
        value = self.rng.choice(["-", "_", ".", " "]).join(self.word() for _ in range(self.rng.randint(2, 4)))
        before, after = self.after_name(self.name(self.PASSWORDS))
        return value if " " not in value or before.endswith(('"', "'")) else value.replace(" ", "-"), before, after

    def short_password(self):
        value = self.rng.choice([self.word() + self.some("0123456789!$%&", self.rng.randint(1, 4)), self.some(_ALNUM + "!$%&*", self.rng.randint(8, 16)), self.word().title() + self.some("!?#*", 1) + self.word()])
        return (value, *self.after_name(self.name(self.PASSWORDS)))

    # What looks like secrets.
    def digest(self):
        name = self.rng.choice(sorted(_DIGEST_WORDS))
        return (self.some(_HEX, self.rng.choice([32, 40, 64])), *self.rng.choice([self.after_name(name), (f"{self.prose()} {name} ", f" {self.prose()}"), self.plain()]))

    def number(self):
        value = self.rng.choice([self.some("0123456789", self.rng.randint(16, 20)), "-".join(self.some("0123456789", 4) for _ in range(4)), f"20{self.some('0123456789', 2)}-01-02T03-04-{self.some('0123456789', 9)}"])
        return (value, *self.rng.choice([self.plain(), self.after_name(self.rng.choice(sorted(_DIGEST_WORDS)))]))

    def uuid(self):
        value = "-".join(self.some(_HEX, n) for n in (8, 4, 4, 4, 12))
        return (value, *self.rng.choice([self.plain(), self.after_name("id"), self.after_name("uuid")]))

    def identifier(self):
        words = [self.word() for _ in range(self.rng.randint(3, 6))]
        value = self.rng.choice(["_".join(words), "-".join(words), words[0] + "".join(w.title() for w in words[1:])]) + self.some("0123456789", self.rng.randint(1, 3))
        return (value, *self.rng.choice([self.plain(), self.after_name(self.word())]))

    def file_path(self):
        return ("/".join([*(self.word() for _ in range(self.rng.randint(3, 5))), self.word() + self.some("0123456789", 2)]), *self.rng.choice([self.plain(), self.after_name(self.word())]))

    def placeholder(self):
        value = self.rng.choice(["xxxx" * self.rng.randint(2, 6), f"your_{self.word()}_here", f"your-{self.word()}-{self.word()}", "example" + self.some("0123456789", 10), "changeme" + self.word(), f"<{self.word()}-{self.word()}>", "${" + self.word().upper() + "_" + self.word().upper() + "}", "placeholder_" + self.word()])
        return (value, *self.after_name(self.name(self.KEYS + self.PASSWORDS)))

    def called(self):
        value = self.rng.choice([f"get_{self.word()}({self.word()})", f"os.environ[{self.word().upper()}]", f"self.{self.word()}_{self.word()}", f"config.{self.word()}.{self.word()}", f"request.{self.word()}", self.word() + "_" + self.word(), f"{self.word()}.{self.word()}()"])
        name = self.name(self.KEYS + self.PASSWORDS)
        return value, f"{self.prose()}\n{name} = ", f"\n{self.prose()}"

    def sentence(self):
        value = self.rng.choice([self.word() + self.word(), self.word().title(), self.word() + "-" + self.word(), self.word() + "."])
        if self.rng.random() < 0.4:
            return self.word(), f"{self.prose(1)} the {self.rng.choice(self.KEYS + self.PASSWORDS).replace('_', ' ')} {self.rng.choice(['is', 'was', 'that is'])} ", f" {self.prose(2)}"
        return value, f"{self.prose(1)} {self.rng.choice(['authors', 'author', 'authority', 'tokens', 'tokenizer', 'secretary', 'authentic'])}: ", f" {self.prose(2)}"

    def data(self):
        before = self.rng.choice(["src=\"data:image/png;base64,", "integrity=\"sha384-", "url(data:font/woff;base64,"])
        return self.some(_ALNUM + "+/", self.rng.randint(60, 400)), f"{self.prose()} {before}", f"\" {self.prose()}"


SECRETS = ("hex_key", "random_key", "provider_key", "web_token", "url_password", "key_block", "word_password", "short_password")
OTHERS = ("digest", "number", "uuid", "identifier", "file_path", "placeholder", "called", "sentence", "data")


def made(rows: int, seed: int, words: list[str], kinds: tuple[str, ...]) -> list[tuple]:
    """(kind, value, before, after, path, label) of so many findings, the kinds in turn."""
    maker = _Maker(seed, words)
    out = []
    for i in range(rows):
        kind = kinds[i % len(kinds)]
        path = maker.rng.choice([None, f"src/{maker.word()}.py", f"{maker.word()}/config.yml", f"{maker.word()}.html"])
        label = int(kind in SECRETS)
        value, before, after = getattr(maker, kind)()
        if kind in ("random_key", "hex_key") and maker.rng.random() < 0.15:
            path, label = maker.rng.choice(["tests/fixtures/", "docs/examples/"]) + maker.word() + ".md", 0
        out.append((kind, value, before, after, path, label))
    return out


def sample_findings(spark: SparkSession, language: Language | None = None, rows: int = 4800, seed: int = 11, kinds: tuple[str, ...] = SECRETS + OTHERS) -> DataFrame:
    """Labelled findings made by rule, for use where no labelled ones are at hand: secrets of many shapes and places, and
    what looks like them but isn't. Words beside them and in identifiers are the dictionary's, so that features of words
    mean in training what they mean in the corpus."""
    words = sorted(w for w in (language.dictionary if language else ()) if len(w) <= 9)
    words = random.Random(seed).sample(words, min(len(words), 3000)) + _PLAIN
    return spark.createDataFrame(made(rows, seed, words, kinds), T._parse_datatype_string(FINDINGS))
