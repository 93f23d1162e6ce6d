"""Secret scan: candidate spans, then a random forest that removes false positives.

Candidates are runs of token characters that are long and hold a digit, and all values right after
an assignment (``=``, ``:``, ``=>``), with or without a digit: whole, up to the closing quote on the
line or, without quotes, the next blank. Where a run lies within such a value, both are candidates,
and redaction masks what any secret among them covers. The forest judges length, character classes,
how usual each character is after the one before, dictionary coverage, the path, and neighbouring
words.

It is trained from labelled findings: those of a table that the caller passes (value, before, after,
path, label), a bounded sample of which is used, or else ``labelled_findings``, a fixed table that is
made by rule after the published formats of common credentials and of what is mistaken for them. Dictionary and
transitions come from a ``Lexicon``: the words of a public vocabulary file, whose path is a parameter.
"""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanack.llm import textcore
from almanack.llm.bpe import read_ranks

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 45, 47, 61, 95]] = True  # + - / = _

# The value after an assignment (and the name of a scheme such as Bearer): quoted, or up to a blank, a quote or the next ``&name=``. What opens a
# bracket, the ``//`` of a URL and ``name=`` with a value of its own are none.
_VALUE = re.compile(rb"""[=:]>?[ \t]*(?i:(?:bearer|basic|token)[ \t]+)?(?:"((?:[^"\\\n]|\\.)+)"|'((?:[^'\\\n]|\\.)+)'|`((?:[^`\\\n]|\\.)+)`|["'`]?(?![=:{\[(<]|//|[\w.-]+=[^\s=]{8})((?:(?!&[\w.-]+=)[^\s"'`])+))""")

# Words that speak for and against a secret, and words that stand in names and placeholders.
FOR_WORDS = ("api", "apikey", "auth", "authorization", "bearer", "credential", "key", "passwd", "password", "private", "pwd", "secret", "token")
AGAINST_WORDS = ("account", "asset", "build", "card", "checksum", "commit", "digest", "hash", "image", "integrity", "isbn", "md5", "order", "phone", "revision", "sha", "sha1", "sha256", "tracking", "uuid", "version")
AGAINST_PATHS = ("doc", "example", "fixture", "lock", "mock", "sample", "spec", "test", "vendor")
DICTIONARY = ("access", "account", "active", "admin", "api", "app", "base", "build", "cache", "changeme", "client", "code", "config", "content", "count", "data", "default", "demo", "dummy", "example", "fake", "file", "format", "group", "here", "image", "index", "info", "insert", "item", "key", "list", "local", "main", "model", "module", "name", "number", "order", "page", "password", "path", "placeholder", "project", "public", "replace", "report", "result", "sample", "secret", "server", "service", "session", "source", "state", "status", "string", "system", "table", "test", "text", "time", "token", "type", "update", "user", "value", "version", "view", "your")

FEATURES = ("length", "digits", "upper", "lower", "signs", "hex_only", "digits_only", "distinct", "entropy", "class_changes", "same_next", "vowel_share", "dictionary", "names", "transitions", "rarest_transition", "longest_letters", "prefix_known", "assigned", "quoted", "for_near", "against_near", "path_against", "path_length", "padding", "groups_of_dash")


@dataclass(frozen=True)
class SecretConfig:
    """``long``: least length of a bare candidate; ``short``: of an assigned one; ``near``: bytes of
    text on each side whose words are read; ``threshold``: least share of trees that call it secret."""

    long: int = 16
    short: int = 8
    near: int = 48
    threshold: float = 0.5
    trees: int = 40
    depth: int = 9
    seed: int = 5
    findings: int = 6000


def _symbol(c: str) -> int:
    """a to z, one symbol for all digits, one for all else."""
    return ord(c) - 97 if "a" <= c <= "z" else 26 if c.isdigit() else 27


class Lexicon:
    """Dictionary words of four letters and more, and how usual each symbol is after another inside them."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = frozenset(w for w in words if len(w) >= 4)
        seen = np.ones((28, 28))
        for w in sorted(self.words):
            for a, b in zip(w, w[1:]):
                seen[_symbol(a), _symbol(b)] += 1
        self.logs = np.log(seen / seen.sum(axis=1, keepdims=True))
        self.found: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"found": None}  # each process makes its own automaton

    def covered(self, low: str) -> float:
        """The share of characters inside some word; one walk over the whole value."""
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for w in self.words:
                self.found.add_word(w, len(w))
            self.found.make_automaton()
        if not self.words:
            return 0.0
        inside = np.zeros(len(low) + 1, dtype=np.int64)
        for end, n in self.found.iter(low):
            inside[end + 1 - n] += 1
            inside[end + 1] -= 1
        return float((np.cumsum(inside[:-1]) > 0).sum()) / max(1, len(low))

    def transitions(self, low: str) -> tuple[float, float]:
        """The mean and the least log probability of a character after the one before."""
        symbols = np.array([_symbol(c) for c in low], dtype=np.int64)
        steps = self.logs[symbols[:-1], symbols[1:]]
        return (float(steps.mean()), float(steps.min())) if len(steps) else (0.0, 0.0)


def read_lexicon(path: str, limit: int = 64 << 20) -> Lexicon:
    """The whole words (those that follow a blank) of a public rank file, read on the driver behind a check of its size."""
    if os.path.getsize(path) > limit:
        raise ValueError("the vocabulary is too large to broadcast")
    return Lexicon({t[1:].decode().lower() for t in read_ranks(path) if re.fullmatch(rb" [A-Za-z]{4,}", t)} | set(DICTIONARY))


def features(value: str, before: str, after: str, path: str, lexicon: Lexicon) -> list[float]:
    """The forest's view of one candidate, of its whole value."""
    n, low = len(value), value.lower()
    kinds = ["d" if c.isdigit() else "u" if "A" <= c <= "Z" else "l" if "a" <= c <= "z" else "s" for c in value]
    tally, chars = Counter(kinds), Counter(value)
    covered = [False] * n
    for word in DICTIONARY:
        at = low.find(word)
        while at >= 0:
            covered[at : at + len(word)] = [True] * len(word)
            at = low.find(word, at + 1)
    letters = max(1, tally["u"] + tally["l"])
    near = re.findall(r"[a-z0-9]+", before.lower())[-4:]
    beside = near + re.findall(r"[a-z0-9]+", after.lower())[:2]
    lead = before.rstrip()[-2:]
    return [
        min(n, 128),
        tally["d"] / n,
        tally["u"] / n,
        tally["l"] / n,
        tally["s"] / n,
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None),
        float(tally["d"] == n),
        len(chars) / min(n, 64),
        -sum(c / n * math.log2(c / n) for c in chars.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1),
        sum(a == b for a, b in zip(value, value[1:])) / max(1, n - 1),
        sum(c in "aeiou" for c in low) / letters,
        lexicon.covered(low),
        sum(covered) / n,
        *lexicon.transitions(low),
        max((len(x) for x in re.findall(r"[A-Za-z]+", value)), default=0),
        float(re.match(r"(AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-)", value) is not None),
        float(re.search(r"[=:]\s*[\"']?$", before) is not None),
        float(lead[-1:] in "\"'" and lead != "" and after[:1] in "\"'" and after != ""),
        float(any(w in FOR_WORDS for w in near)),
        float(any(w in AGAINST_WORDS for w in beside)),
        float(any(w in path.lower() for w in AGAINST_PATHS)),
        min(len(path), 64),
        float(value.endswith("=")),
        value.count("-"),
    ]


def labelled_findings(count: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """``count`` findings (value, before, after, path, label), the same for the same arguments."""
    rng = random.Random(seed)
    pick = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    digit, hexa, up = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alnum = up + up.lower() + digit
    syllables = ("an", "the", "er", "on", "in", "ti", "de", "la", "es", "que", "un", "en", "ver", "ge", "ment", "ion", "re", "st", "ou", "ci")
    noise = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))
    word = lambda: rng.choice(DICTIONARY)
    plain = lambda: (rng.choice(DICTIONARY) if rng.random() < 0.3 else "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))))
    plain_path = lambda: rng.choice(("src%d" % rng.randint(0, 40), "app/settings.py", "config/prod.yaml", "notes.txt", ".env", "web/index.html", ""))
    out = []
    for k in range(count):
        secret = k % 2
        path = plain_path()
        if secret:
            value = rng.choice((lambda: pick(hexa, rng.choice((32, 40, 40, 64))), lambda: "AKIA" + pick(up + digit, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(alnum + "+/", rng.choice((40, 43, 86))) + rng.choice(("", "=")), lambda: "xoxb-" + pick(digit, 11) + "-" + pick(alnum, 24), lambda: "eyJ" + pick(alnum, rng.randint(15, 40)) + rng.choice(("", ".eyJ" + pick(alnum, 30) + "." + pick(alnum + "-_", 43))), lambda: pick(alnum + "-_", rng.randint(12, 30))))()
            chosen = rng.random() < 0.35  # what people choose, and letters alone: only the name tells
            if chosen:
                value = rng.choice((lambda: pick(up + up.lower(), rng.randint(8, 40)), lambda: pick(up.lower(), rng.randint(8, 24)), lambda: pick(alnum + "!@#$%^&*.?", rng.randint(8, 24)), lambda: "".join(plain() for _ in range(rng.randint(2, 4))), lambda: " ".join(plain() for _ in range(rng.randint(3, 5)))))()
            name = rng.choice(FOR_WORDS) if chosen or rng.random() < 0.9 else word()
            sign, mark = rng.choice((" = ", "=", ": ")), rng.choice(('"', '"', "'", ""))
            mark = mark or ('"' if " " in value else "")
            lead, tail = noise() + rng.choice((" ", "\n", "")) + (name + sign if chosen or rng.random() < 0.93 else "") + mark, mark + " " + noise()
        else:
            kind = rng.randrange(17)
            lead, tail = noise() + " ", " " + noise()
            if kind == 0:
                value = pick(digit, rng.choice((16, 16, 17, 18, 20)))
            elif kind == 1:
                value, lead = pick(hexa, rng.choice((32, 40, 64))), noise() + rng.choice((" commit ", " sha1: ", " md5=", " checksum ", " revision "))
            elif kind == 2:
                value, lead = "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), noise() + rng.choice((" uuid=", " id ", ' "id": "', " "))
            elif kind == 3:
                value = "_".join(word() for _ in range(rng.randint(2, 4))) + str(rng.randint(0, 99))
            elif kind == 4:
                value = "/".join(word() for _ in range(rng.randint(2, 5))) + "/" + str(rng.randint(0, 9999))
            elif kind == 5:
                value, lead = rng.choice(("your", "my", "example", "changeme", "replace", "dummy")) + "_" + word() + "_" + rng.choice(("here", "123", "key1", "example")), noise() + " " + rng.choice(FOR_WORDS) + ' = "'
                tail = '" ' + noise()
            elif kind == 6:
                value, path, lead = "sha512-" + pick(alnum + "+/", 86) + "==", rng.choice(("package-lock.json", "yarn.lock")), ' integrity: "'
            elif kind == 7:
                value, lead = rng.choice("x0a1*").replace("*", "9") * rng.randint(12, 40), noise() + " " + rng.choice(FOR_WORDS) + "="
            elif kind == 8:
                value, path = pick(hexa, 40), rng.choice(("tests/fixtures/data.json", "docs/example.md", "spec/mock.rb"))
                lead = noise() + " " + rng.choice(("hash ", "asset ", "build "))
            elif kind == 9:
                value = "".join(rng.choice(syllables).capitalize() for _ in range(rng.randint(5, 9))) + str(rng.randint(0, 9))
            elif kind == 15:  # numbers of parcels and orders, which mix capitals and digits
                value, lead = rng.choice(("1Z", "RR", "SN-", "INV-", "")) + pick(up[:8] + digit * 3, rng.randint(10, 18)), noise() + rng.choice((" tracking: ", " order ", " serial=", " invoice: ", " number: "))
            elif kind == 16:  # one word after a name that else speaks for a secret: a type, a field, a heading
                value, sign = rng.choice([w for w in DICTIONARY if len(w) > 5] + [plain() + rng.choice(("", "tion", "ment", "er"))]), rng.choice((": ", " = ", ":"))
                lead = noise() + " " + rng.choice(FOR_WORDS + ("key", "key")) + sign
            elif kind >= 11:  # what else stands after a colon or an equals sign
                value = rng.choice((lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(4, 8))), lambda: " ".join(plain() for _ in range(rng.randint(3, 30))), lambda: "/".join(plain() for _ in range(3)) + rng.choice((".html", ".png", "?id=" + pick(digit, 3))), lambda: "https://" + plain() + ".com/" + plain(), lambda: plain() + "-" + plain() + "-" + plain()))()
                name, mark = rng.choice(("title", "name", "note", "label", "content", "href", "class", "src", plain(), plain(), plain())), rng.choice(('"', "'", ""))
                mark = mark or ('"' if " " in value else "")
                lead, tail = noise() + " " + name + rng.choice((" = ", "=", ": ")) + mark, mark + " " + noise()
            else:
                value, lead = pick(digit, rng.randint(8, 12)), noise() + rng.choice((" order: ", " phone=", " tracking: ", " card = ", " count = "))
        out.append((value, lead, tail, path, secret))
    return out


class Forest:
    """Random forest of Gini trees, flat arrays, fitted with numpy; and the lexicon that its features come from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows].astype(float), depth, rng))

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []
        todo = [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            rows, level, parent, side = todo.pop()
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, y[rows].mean()])
            if parent >= 0:
                nodes[parent][2 + side] = me
            if level == depth or len(rows) < 6 or nodes[me][4] in (0.0, 1.0):
                continue
            best = (1e-9, -1, 0.0)
            total, n = y[rows].sum(), len(rows)
            for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, c = x[rows[order], f], np.cumsum(y[rows[order]])[:-1]
                k = np.arange(1, n)
                gain = c * c / k + (k - c) ** 2 / k + (total - c) ** 2 / (n - k) + ((n - k) - (total - c)) ** 2 / (n - k)
                gain = np.where((v[1:] > v[:-1]) & (k >= 2) & (n - k >= 2), gain - total**2 / n - (n - total) ** 2 / n, -1)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], f, (v[at] + v[at + 1]) / 2)
            if best[1] < 0:
                continue
            nodes[me][0], nodes[me][1] = best[1], best[2]
            left = x[rows, best[1]] <= best[2]
            todo += [(rows[left], level + 1, me, 0), (rows[~left], level + 1, me, 1)]
        t = np.array(nodes)
        return t[:, 0].astype(int), t[:, 1], t[:, 2:4].astype(int), t[:, 4]

    def prob(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, child, value in self.trees:
            at = np.zeros(len(x), dtype=int)
            while (go := feature[at] >= 0).any():
                right = (x[every, np.maximum(feature[at], 0)] > cut[at]).astype(int)
                at = np.where(go, child[at, right], at)
            votes += value[at]
        return votes / len(self.trees)


def fit_secrets(lexicon: Lexicon, config: SecretConfig = SecretConfig(), findings: DataFrame | None = None) -> Forest:
    """A forest from labelled findings, on the driver.

    ``findings(value, before, after, path, label)`` may be of any size: the ``config.findings`` rows with the
    smallest hashes are used (ties by the columns). Rows without value or label teach nothing, and
    other nulls are empty. Without a table, or where a label is missing from it, the fixed one is used.
    """
    rows = labelled_findings(config.findings, config.seed)
    if findings is not None:
        names = ["value", "before", "after", "path"]
        some = findings.filter("length(value) > 0 and label in (0, 1)").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in names), F.col("label").cast("int").alias("label"))
        given = [tuple(r) for r in some.orderBy(F.xxhash64(*names), *names, "label").limit(config.findings).collect()]
        rows = given if len({r[4] for r in given}) == 2 else rows
    x = np.array([features(*r[:4], lexicon) for r in rows], dtype=float)
    return Forest(x, np.array([r[4] for r in rows]), config.trees, config.depth, config.seed, lexicon)


def _values(data: np.ndarray, offs: np.ndarray, config: SecretConfig) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the values right after assignments."""
    signs = np.flatnonzero((data == 61) | (data == 58))
    row = np.searchsorted(offs, signs, "right") - 1
    last, text, taken = -1, b"", 0
    for r, at in zip(row.tolist(), signs.tolist(), strict=True):
        if r != last:
            last, text, taken = r, data[offs[r] : offs[r + 1]].tobytes(), 0
        at -= int(offs[r])
        if at < taken:
            continue
        if found := _VALUE.match(text, at):
            a, b = found.span(found.lastindex)
            if found.lastindex == 4:
                taken = b
                b = a + len(text[a:b].rstrip(b",;.)]}>"))
            if b - a >= config.short:
                yield r, int(offs[r]) + a, int(offs[r]) + b


def _candidates(data: np.ndarray, offs: np.ndarray, config: SecretConfig) -> list[tuple[int, int, int]]:
    """(row, start, end) of candidate spans in a slice's bytes, each once and in order."""
    out = set(_values(data, offs, config))
    starts, ends = textcore.runs(_TOKEN[data], offs)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    some = (ends - starts >= config.short) & (digits[ends] > digits[starts])
    starts, ends = starts[some], ends[some]
    # The value of ``name=value`` without blanks or quotes is what follows the last sign.
    row = np.searchsorted(offs, starts, "right") - 1
    for r, a, b in zip(row.tolist(), starts.tolist(), ends.tolist(), strict=True):
        value = data[a:b].tobytes()
        cut = value.rstrip(b"=").rfind(b"=")
        if cut >= 0:
            a += cut + 1
        lead = data[max(int(offs[r]), a - 4) : a].tobytes().rstrip(b" \"'")
        if b - a >= config.long or (b - a >= config.short and lead[-1:] in (b"=", b":")):
            out.add((r, a, b))
    return sorted(out)


def _judge(texts: pa.Array, paths: list, forest: Forest, config: SecretConfig) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]]:
    """For each slice: its first row, bytes, offsets, candidates, and the share of trees for a secret."""
    for lo, _, data, offs in textcore.slices(texts):
        found = _candidates(data, offs, config)
        x = []
        for r, a, b in found:
            before = data[max(int(offs[r]), a - config.near) : a].tobytes().decode("utf-8", "ignore")
            after = data[b : min(int(offs[r + 1]), b + config.near)].tobytes().decode("utf-8", "ignore")
            x.append(features(data[a:b].tobytes().decode("utf-8", "ignore"), before, after, str(paths[lo + r] or ""), forest.lexicon))
        yield lo, data, offs, found, forest.prob(np.array(x)) if found else np.zeros(0)


def scan_secrets(docs: DataFrame, forest: Forest, config: SecretConfig = SecretConfig(), id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, span in the UTF-8 text, SHA-256 of the value, probability, verdict.

    The value itself is not returned. Null and empty texts have no candidates; a null path, or a table
    without that column, has an empty one. Repeated rows give repeated findings. Candidates may overlap
    (a run within a quoted value) and are judged each, in the order of start and end. Very long texts and values
    are read whole, in a task that holds one of them. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    base = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string"))
    schema = f"{id_col} long, start_byte long, end_byte long, value_sha256 string, probability double, is_secret boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offs, found, p in _judge(batch.column(1), batch.column(2).to_pylist(), sent.value, config):
                if found:
                    r, a, b = map(np.array, zip(*found, strict=True))
                    sha = [hashlib.sha256(data[x:y].tobytes()).hexdigest() for x, y in zip(a, b, strict=True)]
                    yield pa.record_batch([batch.column(0).take(pa.array(r + lo)), pa.array(a - offs[r]), pa.array(b - offs[r]), pa.array(sha), pa.array(p), pa.array(p >= config.threshold)], names=[x.split()[0] for x in schema.split(", ")])

    return base.mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, forest: Forest, config: SecretConfig = SecretConfig(), text_col: str = "text", path_col: str = "source", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with secrets in the text replaced by ``mask``; ``n_chars``, where there
    is such a column, is that of the new text. Nulls stay null; a table without the path's column has empty paths."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(text_col))
            new: dict[int, bytearray] = {}
            for lo, data, offs, found, p in _judge(column, batch.column(names.index(path_col)).to_pylist() if path_col in names else [None] * batch.num_rows, sent.value, config):
                spans: list[list[int]] = []  # overlapping secrets are masked as one
                for (r, a, b), share in zip(found, p, strict=True):
                    if share >= config.threshold:
                        if spans and spans[-1][0] == r and a < spans[-1][2]:
                            spans[-1][2] = max(b, spans[-1][2])
                        else:
                            spans.append([r, a, b])
                for r, a, b in reversed(spans):
                    text = new.setdefault(lo + r, bytearray(data[offs[r] : offs[r + 1]].tobytes()))
                    text[a - int(offs[r]) : b - int(offs[r])] = mask.encode()
            if new:
                values = column.to_pylist()
                for i, text in new.items():
                    values[i] = text.decode()
                columns = list(batch.columns)
                columns[names.index(text_col)] = pa.array(values, type=column.type)
                if "n_chars" in names:
                    at = names.index("n_chars")
                    sizes = columns[at].to_pylist()
                    for i in new:
                        sizes[i] = len(values[i])
                    columns[at] = pa.array(sizes, type=columns[at].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
