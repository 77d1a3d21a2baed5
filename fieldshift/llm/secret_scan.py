"""Secret scans: pattern candidates, then a random forest that removes false positives.

The forest looks at a candidate's length, character transitions, dictionary coverage, path marks and neighbouring
words. Transitions are log-probabilities of letter pairs, and the dictionary the words, of a tokenizer's vocabulary file.
It is trained on the driver from labelled findings, at most ``MOST_FINDINGS`` of them, and broadcast; its size is bounded
by the number and depth of the trees and by the vocabulary. Scoring happens where a text lies, in one pass without a
shuffle, in time that grows with the length of a text.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import read_ranks
from .support import map_documents

#: Bound of the training sample; more labelled findings are thinned evenly.
MOST_FINDINGS = 4000
TREES, DEPTH, LEAST_LEAF, SEED = 24, 9, 2, 11
#: Vote from which a candidate is a secret.
CUT = 0.5
#: Characters to either side that count as neighbourhood.
AROUND = 48

#: Candidate patterns in order of preference; the group "v" is the candidate.
PATTERNS = [
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?P<v>[A-Za-z0-9+/=\s]{16,})(?:-----END|$)"),
    ("aws_key_id", r"(?<![A-Za-z0-9])(?P<v>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9_])(?P<v>gh[pousr]_[A-Za-z0-9]{36,})"),
    ("gitlab_token", r"(?<![A-Za-z0-9_])(?P<v>glpat-[A-Za-z0-9_-]{20,})"),
    ("slack_token", r"(?<![A-Za-z0-9_])(?P<v>xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("stripe_key", r"(?<![A-Za-z0-9_])(?P<v>[sr]k_(?:live|test)_[A-Za-z0-9]{16,})"),
    ("google_key", r"(?<![A-Za-z0-9_])(?P<v>AIza[A-Za-z0-9_-]{35})"),
    ("jwt", r"(?<![A-Za-z0-9_])(?P<v>eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"),
    (
        "assigned",
        r"(?i:(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)[a-z_]{0,16}"
        r"[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3})(?P<q>[\"'])(?P<v>[^\s\"']{8,})(?P=q)",
    ),
    (
        "bare_assigned",
        r"(?i:(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[a-z_]{0,16}\s{0,3}(?:=>|:=|=|:)\s{0,3})"
        r"(?P<v>[A-Za-z0-9_./+-]{8,}={0,2})",
    ),
    ("hex", r"(?<![A-Za-z0-9])(?P<v>[0-9a-fA-F]{32,})(?![A-Za-z0-9])"),
    ("mixed", r"(?<![A-Za-z0-9/+_.-])(?P<v>(?=[A-Za-z/+_-]*[0-9])[A-Za-z0-9/+_-]{24,}={0,2})(?![A-Za-z0-9/+_-])"),
]
_COMPILED = [(kind, re.compile(p)) for kind, p in PATTERNS]
#: For each pattern a part of it that every match holds; texts without any are passed over quickly.
HINTS = {
    "private_key": r"-----BEGIN ",
    "slack_token": r"xox[abprs]-",
    "jwt": r"eyJ[A-Za-z0-9_-]{10}",
    **dict.fromkeys(["assigned", "bare_assigned"], r"(?:=>|=|:)\s{0,3}[\"']?[^\s\"']{8}"),
    **dict.fromkeys(["aws_key_id", "github_token", "gitlab_token", "stripe_key", "google_key", "hex", "mixed"], r"[A-Za-z0-9/+_-]{16}"),
}
_HINT = re.compile("|".join(dict.fromkeys(HINTS[kind] for kind, _ in PATTERNS)))

#: Words that speak for or against a secret nearby.
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "credential", "bearer", "login")
AGAINST = ("example", "sample", "dummy", "placeholder", "test", "fake", "uuid", "guid", "commit", "revision", "checksum",
           "sha1", "sha256", "md5", "digest", "hash", "integrity", "etag", "version", "xxx", "your", "redacted")
_FOR, _AGAINST = re.compile("|".join(FOR)), re.compile("|".join(AGAINST))
#: A neighbouring word: white space ends it, what isn't a letter or digit around it doesn't belong to it.
_WORD = re.compile(r"(?<!\S)[^\sa-z0-9]*([a-z0-9]+)[^\sa-z0-9]*(?!\S)")
_PATH_BEFORE, _ASSIGNED = re.compile(r"(?:https?://|/|\\)\S*$"), re.compile(r"[=:]\s{0,3}[\"']?$")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_NOT_HEX = re.compile("[^0-9a-f]")

FEATURES = (
    "length", "classes", "class_changes", "entropy", "transitions", "repeats", "steps", "digit_share", "upper_share",
    "covered", "longest_word", "path_marks", "path_before", "for_near", "against_near", "against_inside", "quoted",
    "assigned", "provider", "uuid_shape", "hex_only",
)

#: Letters of the shortest dictionary word that counts as coverage.
LEAST_WORD = 4
_CLASS = bytes(0 if 48 <= c < 58 else 1 if 97 <= c < 123 else 2 if 65 <= c < 91 else 3 for c in range(256))
_LETTER = bytes(c - 97 if 97 <= c < 123 else c - 65 if 65 <= c < 91 else 26 for c in range(256))


class Language:
    """Words and letter transitions of a vocabulary: what a candidate is compared with."""

    def __init__(self, tokens: Iterable[str]):
        words = [t.strip().lower() for t in tokens]
        self.words = sorted({w for w in words if len(w) >= LEAST_WORD and w.isascii() and w.isalpha()})
        counts = np.ones((26, 26))
        for word in self.words:
            letters = np.frombuffer(word.encode().translate(_LETTER), np.uint8)
            np.add.at(counts, (letters[:-1], letters[1:]), 1)
        self.log = np.log2(counts / counts.sum(axis=1, keepdims=True))
        self.automaton = ahocorasick.Automaton()
        for word in self.words:
            self.automaton.add_word(word, len(word))
        if self.words:
            self.automaton.make_automaton()

    def __reduce__(self):
        return Language, (self.words,)

    @classmethod
    def of_vocabulary(cls, path: str) -> Language:
        return cls(t.decode("utf-8", "ignore") for t in read_ranks(path))

    def transitions(self, value: bytes) -> float:
        """Mean log2-probability of the pairs of letters that stand side by side; that of even odds where none do."""
        letters = np.frombuffer(value.translate(_LETTER), np.uint8)
        a, b = letters[:-1], letters[1:]
        both = (a < 26) & (b < 26)
        return float(self.log[a[both], b[both]].mean()) if both.any() else -math.log2(26)

    def covered(self, low: str) -> tuple[float, int]:
        """Share of the characters that lie in words, leftmost and longest first, and the length of the longest word."""
        sizes = [n for _, n in self.automaton.iter_long(low)] if self.words else []
        return sum(sizes) / max(1, len(low)), max(sizes, default=0)


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str


def candidates(text: str) -> list[Candidate]:
    """Candidate places in order; of overlapping ones the first pattern's stays."""
    found: list[Candidate] = []
    if not _HINT.search(text):
        return found
    for kind, pattern in _COMPILED:
        fresh, at = [], 0  # both lists go by place, so that each pattern takes one walk along them
        for m in pattern.finditer(text):
            start, end = m.span("v")
            while at < len(found) and found[at].end <= start:
                at += 1
            if at == len(found) or found[at].start >= end:
                fresh.append(Candidate(start, end, kind))
        if fresh:
            found = sorted(found + fresh, key=lambda c: c.start)
    return found


def features(text: str, c: Candidate, language: Language) -> list[float]:
    value = text[c.start : c.end]
    n, low = len(value), value.lower()
    raw = value.encode("ascii", "replace")
    codes = np.frombuffer(raw, np.uint8).astype(np.int16)
    kinds = np.frombuffer(raw.translate(_CLASS), np.uint8)
    step = np.diff(codes)
    share = np.bincount(codes) / n
    share = share[share > 0]
    before, after = text[max(0, c.start - AROUND) : c.start].lower(), text[c.end : c.end + AROUND].lower()
    near = before[-24:] + " " + after[:12]
    covered, longest = language.covered(low)
    return [
        float(n),
        float(len(set(kinds.tolist()))),
        float((kinds[1:] != kinds[:-1]).sum()) / max(1, n - 1),
        float(-(share * np.log2(share)).sum()),
        language.transitions(raw),
        float((step == 0).sum()) / max(1, n - 1),
        float((np.abs(step) == 1).sum()) / max(1, n - 1),
        float((kinds == 0).sum()) / n,
        float((kinds == 2).sum()) / n,
        covered,
        float(longest),
        float(sum(value.count(x) for x in "/\\.") + value.count("::")),
        float(bool(_PATH_BEFORE.search(before))),
        float(len(_FOR.findall(near))),
        float(sum(w in AGAINST for w in _WORD.findall(before + " " + after))),
        float(len(_AGAINST.findall(low))),
        float(before[-1:] in ("'", '"') and c.start > 0),
        float(bool(_ASSIGNED.search(before))),
        float(c.kind not in ("assigned", "bare_assigned", "hex", "mixed")),
        float(bool(_UUID.fullmatch(low))),
        float(not _NOT_HEX.search(low)),
    ]


class Forest:
    """Trees grown on bootstrap samples, a random share of features per node, splits by Gini impurity."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        take = max(1, int(math.sqrt(x.shape[1])) + 1)
        grown = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []  # feature, cut, left, right, vote

            def grow(rows: np.ndarray, level: int) -> int:
                at = len(nodes)
                vote = float(y[rows].mean())
                nodes.append([-1, 0.0, -1, -1, vote])
                if level < depth and 0 < vote < 1 and len(rows) >= 2 * LEAST_LEAF:
                    best = cls._split(x, y, rows, rng.choice(x.shape[1], take, replace=False))
                    if best:
                        feature, cut = best
                        left = x[rows, feature] <= cut
                        nodes[at][:4] = [feature, cut, grow(rows[left], level + 1), grow(rows[~left], level + 1)]
                return at

            grow(rows, 0)
            table = np.array(nodes)
            grown.append((table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]))
        return cls(grown)

    @staticmethod
    def _split(x: np.ndarray, y: np.ndarray, rows: np.ndarray, picks: np.ndarray) -> tuple[int, float] | None:
        best, least = None, np.inf
        for feature in picks:
            values = x[rows, feature]
            order = np.argsort(values, kind="stable")
            values, labels = values[order], y[rows][order]
            n = np.arange(1, len(rows))
            left = np.cumsum(labels)[:-1]
            right = labels.sum() - left
            p, q = left / n, right / (len(rows) - n)
            impurity = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
            impurity[(values[1:] <= values[:-1]) | (n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = np.inf
            at = int(np.argmin(impurity))
            if impurity[at] < least:
                least, best = impurity[at], (int(feature), float((values[at] + values[at + 1]) / 2))
        return best

    def votes(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, vote in self.trees:
            node = np.zeros(len(x), int)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += vote[node]
        return total / max(1, len(self.trees))


def labelled_findings(words: Sequence[str], count: int = MOST_FINDINGS, seed: int = SEED) -> list[tuple[str, bool]]:
    """Made findings: a text with one candidate, and whether it is a secret; every second one is a false positive.

    A finding is put together of a name, a way to assign, a value and what stands around it, each drawn by itself. Random
    values under names of secrets and random values behind a provider's prefix are secrets. Not so are checksums,
    revisions and identifiers, paths and addresses, names made of words, templates, runs and repetitions, and what a
    document says is an example.
    """
    rng = random.Random(seed)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    draw = lambda chars, n: "".join(rng.choices(chars, k=n))
    hexes = lambda n: draw(rng.choice(["0123456789abcdef", "0123456789ABCDEF"]), n)
    some = lambda n: rng.choices(words, k=n)
    uuid = lambda: "-".join(hexes(k) for k in (8, 4, 4, 4, 12))
    joined = lambda n: rng.choice(["_", "-", "."]).join(some(n))

    def prose(n: int) -> str:
        odd = lambda w: rng.choice([draw("abcdefghilmnoprstu", rng.randint(2, 9)), f"{w}@mail.{rng.choice(words)}.com", f"{w}-{rng.randint(1, 99)}"])
        return rng.choice([" ", " ", ", ", "\n"]).join(odd(w) if rng.random() < 0.3 else w for w in some(n))

    def named(stems: list[str]) -> str:
        stem = rng.choice(stems)
        name = rng.choice([stem, f"{rng.choice(words)}_{stem}", f"{stem}_{rng.randint(1, 9)}" if stem.isascii() and rng.random() < 0.2 else stem])
        return rng.choice([name, name.upper(), name.capitalize(), name.replace("_", "-")])

    def assigned(name: str, value: str) -> str:
        q = rng.choice(["'", '"'])
        return rng.choice([f"{name} = {q}{value}{q}", f"{name}={q}{value}{q}", f"{q}{name}{q}: {q}{value}{q}", f"{q}{name}{q} => {q}{value}{q}", f"{name}: {value}", f"export {name}={value}"])

    kept = ["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "client_secret", "credential", "private_key"]
    plain = ["id", "uuid", "sha1", "sha256", "md5", "checksum", "digest", "etag", "commit", "revision", "integrity", "build_hash", "version"]

    def random_value() -> str:
        return rng.choice([
            lambda: hexes(rng.choice([24, 32, 40, 40, 48, 64])), lambda: draw(alnum, rng.randint(16, 64)), lambda: draw(b64, rng.choice([28, 40, 44, 64, 88])),
            lambda: draw(alnum + "!@%^-_$", rng.randint(10, 24)), lambda: f"{draw(alnum, 8)}.{draw(alnum + '-_', rng.randint(20, 40))}",
        ])()

    def secret() -> str:
        return rng.choice([
            *[lambda: assigned(named(kept), random_value())] * 6,
            lambda: rng.choice(["AKIA", "ASIA"]) + draw(string.ascii_uppercase + string.digits, 16), lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + draw(alnum, 36),
            lambda: "glpat-" + draw(alnum, 20), lambda: rng.choice(["sk_live_", "rk_live_"]) + draw(alnum, 24), lambda: "xoxb-" + draw(string.digits, 11) + "-" + draw(alnum, 24),
            lambda: "AIza" + draw(alnum, 35), lambda: f"eyJ{draw(alnum, 20)}.{draw(alnum, 40)}.{draw(alnum, 43)}",
            lambda: f"-----BEGIN RSA PRIVATE KEY-----\n{draw(b64, 64)}\n{draw(b64, 64)}\n-----END",
        ])()

    def run() -> str:
        cycle = rng.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "1234567890", "ABCDEFGH01234567", "deadbeef", "x", "0", "*", "a1", "xX"])
        return (cycle * 40)[: rng.choice([16, 24, 32, 40, 64])]

    def false_alarm() -> str:
        return rng.choice([
            lambda: assigned(named(plain), rng.choice([hexes(32), hexes(40), hexes(64), uuid(), draw(b64, 43) + "="])),
            lambda: f"{rng.choice(plain)} {rng.choice([hexes(32), hexes(40), hexes(64), uuid()])}", lambda: f"sha{rng.choice([1, 256, 512])}{rng.choice('-:')}{draw(b64, 43)}=",
            lambda: assigned(named(kept), joined(rng.randint(2, 4))), lambda: assigned(named(kept), rng.choice(["your", "my", "the", "enter"]) + "_" + joined(2) + "_here"),
            lambda: assigned(named(kept), rng.choice(["<{}>", "${{{}}}", "{{{{{}}}}}", "%({})s"]).format("_".join(some(rng.randint(2, 3))))),
            lambda: assigned(named(kept), f"{rng.choice(['config', 'os.environ', 'self', 'process.env', 'settings'])}.{joined(2)}"),
            lambda: assigned(named(kept), rng.choice(["example", "sample", "dummy", "test", "changeme", "placeholder"]) + rng.choice(["-", "_", ""]) + rng.choice([joined(1), draw(string.digits, 6)])),
            lambda: assigned(named(kept), run()), lambda: assigned(named(kept), "/" + "/".join(some(rng.randint(3, 5))) + rng.choice(["", ".pem", ".key", "/v2"])),
            lambda: f"https://{rng.choice(words)}.com/{'/'.join(some(rng.randint(2, 4)))}/{rng.choice([hexes(32), '-'.join(some(5)) + '-2024', uuid()])}",
            lambda: "/" + "/".join(some(rng.randint(4, 6))) + f"/v{rng.randint(1, 9)}", lambda: "-".join(some(4)) + f"-20{rng.randint(10, 29)}", lambda: f"{'_'.join(some(5))}_{rng.randint(1, 99)}",
            lambda: "".join(w.capitalize() for w in some(5)) + str(rng.randint(1, 999)), lambda: "AKIA" + "EXAMPLE" * 2 + "XX", lambda: "ghp_" + run()[:16].ljust(36, "x"),
            lambda: f"for example {assigned(named(kept), random_value())} is a dummy",
        ])()

    out = []
    while len(out) < count:
        true = len(out) % 2 == 0
        lead = f"{prose(rng.randint(1, 6))}{rng.choice([' ', chr(10), ' (', '; '])}" if rng.random() < 0.8 else ""
        tail = rng.choice(["", " ", ".", ", ", " | ", ";", ")", "\n", "!!", " # ", "###"])
        text = f"{lead}{secret() if true else false_alarm()}{tail}{prose(rng.randint(0, 6))}"
        if candidates(text):
            out.append((text, true))
    return out


@dataclass(frozen=True)
class Model:
    """A forest and the language that its features are taken by."""

    forest: Forest
    language: Language

    def votes(self, text: str, found: list[Candidate]) -> list[float]:
        return self.forest.votes(np.array([features(text, c, self.language) for c in found])).tolist() if found else []


def train(findings: list[tuple[str, bool]], language: Language, most: int = MOST_FINDINGS, seed: int = SEED) -> Model:
    """A model from labelled findings; every candidate in a finding's text carries its label."""
    step = max(1, math.ceil(len(findings) / most))
    rows = [(features(t, c, language), label) for t, label in findings[::step] for c in candidates(t)]
    if not rows:
        return Model(Forest([]), language)
    return Model(Forest.fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), seed=seed), language)


_models: dict[str, Model] = {}


def default_model(vocabulary: str) -> Model:
    """The model over made findings, trained once per driver; the language is that of a vocabulary file."""
    if vocabulary not in _models:
        language = Language.of_vocabulary(vocabulary)
        _models[vocabulary] = train(labelled_findings(language.words), language)
    return _models[vocabulary]


def judge(text: str | None, model: Model) -> list[tuple[Candidate, float]]:
    found = candidates(text) if text else []
    return list(zip(found, model.votes(text, found))) if found else []


FINDINGS = "doc_id long, n_candidates long, findings array<struct<start:int,stop:int,kind:string,score:double,secret:boolean>>"
_FINDING = pa.list_(
    pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())])
)


def scan(docs: DataFrame, model: Model, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_candidates, findings): a row per row of ``docs``, with each candidate's place in characters, kind and vote.

    A null or empty text has no candidates. Ids may be null or repeated; an empty table gives no row; extra columns are
    ignored. Whole texts are scanned and whole values judged.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [judge(t, shared.value) for t in batch.column(1).to_pylist()]
            found = [
                [{"start": c.start, "stop": c.end, "kind": c.kind, "score": v, "secret": v >= cut} for c, v in row] for row in rows
            ]
            arrays = [batch.column(0).cast(pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array(found, _FINDING)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_candidates", "findings"])

        return apply

    return map_documents(docs, [id_col, text_col], FINDINGS, make)


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each (start, end, kind) span replaced by a tag."""
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], f"<{kind}>"]
        at = end
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, model: Model, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``<kind>``; other columns and all rows stay as they are.

    A null text stays null and an empty one empty; texts of any length are scanned whole; repeated rows are treated alike;
    an empty table gives no row. Columns pass by position, so that no name can clash.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, text in enumerate(texts):
                spans = [(c.start, c.end, c.kind) for c, v in judge(text, shared.value) if v >= cut]
                if spans:
                    texts[i] = mask(text, spans)
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
