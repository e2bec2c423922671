"""Secret scanning with a random forest that removes false positives.

Candidates are long tokens that aren't made of dictionary words alone, values assigned to names such
as password or token, and private key blocks (a block without its end goes as far as its
lines of base64).  A random forest, trained from labelled findings, decides which of them
are secrets, by their length, character
classes and transitions, the likelihood of their letter pairs, the share of them
that dictionary words cover, whether they stand in a path, the document's source
and the words before and after.

The labelled findings are drawn from ``labelled_findings``: documented patterns
of real credentials and of what scanners take for them, filled at random.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import table

MASK = "[SECRET]"
#: Labelled findings to train on; trees; levels of a tree.
FINDINGS, TREES, DEPTH = 4000, 40, 9
LEAST = 16

_TOKEN = bytes(b if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=.~" else 32 for b in range(256))
_LONG = re.compile(r"[A-Za-z0-9+/_\-=.~]{16,}")
_NAMES = r"pass(?:word|wd|phrase)?|pwd|secret(?:[_-]?key)?|(?:access|auth|api|client|private|bearer|refresh|session)?[_-]?token|(?:api|access|secret|private|auth|encryption)[_-]?key|client[_-]?secret|credentials?|connection[_-]?string|authorization|bearer"
_ASSIGNED = re.compile(rf"(?<![A-Za-z])(?:[A-Za-z0-9]+[_-])*(?:{_NAMES})[\"']?(?:\s*(?::=|=>|=|:)\s*|\s+)[\"'`]?(?:bearer\s+|basic\s+)?([^\s\"'`,;<>(){{}}|]{{6,}})", re.I)
_ASSIGNS = re.compile(rf"(?<![A-Za-z])(?:[A-Za-z0-9]+[_-])*(?:{_NAMES})[\"']?\W{{0,12}}\s*(?::=|=>|=|:)\W{{0,12}}$", re.I)
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
_BETWEEN, _HEADER = r"[\s\"'\\,>|#*]", r"(?:Proc-Type|DEK-Info|Version|Comment)\s?:[^\n\\]{0,200}"
#: What may follow: headers and base64 up to the end line, or, without one, as far as lines of base64 go.
_CLOSED = re.compile(rf"(?:{_BETWEEN}*+(?:{_HEADER}|[A-Za-z0-9+/=]++))*+{_BETWEEN}*+-----END (?:[A-Z]+ )*PRIVATE KEY-----")
_OPEN = re.compile(rf"(?:{_BETWEEN}*+(?:{_HEADER}|[A-Za-z0-9+/=]{{32,}}+))*+")
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"connection", b"authorization", b"bearer")
_PREFIX = re.compile(r"(?:-----BEGIN|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|ya29\.|SG\.|eyJ|npm_|dop_v1_|hf_)", re.I)
_SECRET_WORD = re.compile(rf"(?<![a-z])(?:{_NAMES}|login|creds?|authenticate|aws|oauth|jwt)(?![a-z])", re.I)
_SAFE_WORD = re.compile(r"(?<![a-z])(?:commit|revision|rev|sha|sha1|sha256|sha512|md5|hash|checksum|digest|integrity|etag|uuid|guid|id|order|invoice|isbn|doi|tracking|serial|build|version|card|phone|example|sample|dummy|fake|placeholder|test|fixture|color|base64|image|data|file|trace|request)(?![a-z])", re.I)
_DUMMY = re.compile(r"x{4,}|\*{3,}|\.{3,}|your|example|placeholder|change.?me|dummy|sample|redacted|todo|insert|<|\$\{|%\(|abcdef|123456|(.)\1{5,}", re.I)
_PART = re.compile(r"[^=]+")
_RUN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_DICTIONARY = frozenset(
    "about access account action active address after again agent alert allow also always another answer application around asset author back base before below between block board body book border branch browser build button call cannot case center change channel check class clear client close cloud code collection color column comment common company config connection content control copy count create current custom data database date debug default delete deploy design detail device dialog different directory display document domain download each edit element email empty enable entry error event every example export external factory false family field file filter final find first folder font footer form format found frame from function general generate global good great group handle header height help hidden home host house html http https icon image import index info input inside install instance internal interface issue item java just know label language large last latest layout left length level library light like line link list little live load local location long look main make manager many map master match menu message method mode model module more most move name need network never next node normal note number object only open option order other output over package page panel parent part password path people person place plugin point policy post power press price primary print private process product profile program project public query question quick read record region release remote remove report request reset resource response result return right role root route rule sample save schema screen script search second secret section secure security select server service session setting share should show simple single size small sort source space start state static status step still storage store stream string style submit support switch system table target task team template test text that their them then there these they thing think this time title token tool total track true type under unique update upload user util value version video view water website what when where which while width will window with word work world would write year your"
    .split()
)


def _explained(v: str) -> bool:
    """Nothing but dictionary words, in letters alone."""
    return not any(c.isdigit() for c in v) and all(len(r) < 3 or r.lower() in _DICTIONARY for r in _RUN.findall(v)) and max(map(len, _RUN.findall(v)), default=0) > 2


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what may be a secret, in order, without overlaps."""
    data = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, str]] = []
    if b"-----BEGIN" in data:
        found += [(m.start(), (_CLOSED.match(text, m.end()) or _OPEN.match(text, m.end())).end(), "key") for m in _PEM.finditer(text)]
    low = data.lower()
    if any(h in low for h in _HINTS):
        found += [(*m.span(1), "assigned") for m in _ASSIGNED.finditer(text)]
    if any(len(w) >= LEAST for w in data.translate(_TOKEN).split()):
        named = list(found)
        for m in _LONG.finditer(text):
            a, b = m.span()
            while b > a and text[b - 1] in ".-_/":
                b -= 1
            while a < b and text[a] in ".-/=":
                a += 1
            if b - a < LEAST:
                continue
            # name=value, and more of them; up to two signs at the end are padding
            c = b - min(2, b - a - len(text[a:b].rstrip("=")))
            parts = [(a + p.start(), a + p.end()) for p in _PART.finditer(text[a:c])]
            if parts and parts[-1][1] == c:
                parts[-1] = (parts[-1][0], b)
            parts = [p for p in parts if p[1] - p[0] >= LEAST] or [(a, b)] * (not any(s < b and e > a for s, e, _ in named))
            found += [(*p, "token") for p in parts if not _explained(text[p[0] : p[1]])]
    out: list[tuple[int, int, str]] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _pairs() -> np.ndarray:
    """Log-likelihoods of letter pairs in dictionary words."""
    n = np.full((27, 27), 0.5)
    for w in _DICTIONARY:
        codes = [0, *(ord(c) - 96 for c in w), 0]
        for x, y in zip(codes, codes[1:]):
            n[x, y] += 1
    return np.log(n / n.sum(1, keepdims=True))


_PAIRS = _pairs()
_KIND = {**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", 0), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), **dict.fromkeys("0123456789", 2)}


def features(text: str, start: int, end: int, source: str = "") -> list[float]:
    v = text[start:end]
    n = len(v)
    kinds = [_KIND.get(c, 3) for c in v]
    share = [kinds.count(k) / len(v) for k in range(4)]
    counts = Counter(v)
    entropy = -sum(c / len(v) * math.log2(c / len(v)) for c in counts.values())
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(v) - 1)
    letters = [ord(c) - 96 if "a" <= c <= "z" else 0 for c in v.lower()]
    likely = float(np.mean([_PAIRS[a, b] for a, b in zip(letters, letters[1:])])) if len(letters) > 1 else 0.0
    covered = sum(len(w) for run in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", v) for w in [run.lower()] if w in _DICTIONARY) / len(v)
    alpha = max((len(x) for x in re.findall(r"[A-Za-z]+", v)), default=0) / len(v)
    digits = max((len(x) for x in re.findall(r"\d+", v)), default=0) / len(v)
    before, after = text[max(0, start - 60) : start], text[end : end + 40]
    near = " ".join(before.split()[-4:])
    last = before.split()[-1] if before.split() and not before[-1:].isspace() else ""
    return [
        math.log2(n), *share, entropy, entropy / math.log2(max(2, len(counts))) if len(counts) > 1 else 0.0, changes, likely, covered, alpha, digits, len(counts) / len(v),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", v))), float(v.isdigit()), float(bool(_PREFIX.match(v))), float(bool(_UUID.fullmatch(v))),
        float(bool(_ASSIGNS.search(before))), float(bool(_SECRET_WORD.search(near))), float(bool(_SAFE_WORD.search(near))), float(bool(_SAFE_WORD.search(" ".join(after.split()[:3])))),
        float(before[-1:] in "\"'`" and before != ""), float(v.count("/") / len(v)), float("://" in last or "/" in last or after[:1] == "/" or "." in last), float(bool(_DUMMY.search(v))),
        float(bool(re.search(r"test|example|doc|sample|fixture", source, re.I))), float(len(v) in (32, 40, 56, 64, 96, 128)),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: a secret) of ``n`` findings."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    chars = lambda abc, k: "".join(pick(abc) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64 = "0123456789abcdef", low + up + dig
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve éa ió ung sch que ment ción tion keit eau los".split()
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 5)))) if rng.random() < 0.7 else pick(sorted(_DICTIONARY))
    text = lambda k: " ".join(word() for _ in range(k))
    names = "token password secret api_key apikey access_token auth_token client_secret passwd pwd secret_key private_key API_KEY AWS_SECRET_ACCESS_KEY GITHUB_TOKEN DB_PASSWORD Authorization".split()
    assign = lambda name, v: pick(['{n} = "{v}"', "{n}='{v}'", "{n}={v}", '"{n}": "{v}"', "{n}: {v}", "{n} := `{v}`", "export {n}={v}", "{n} {v}"]).format(n=name, v=v)

    def block(lines: int) -> str:
        kind, width = pick(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]), int(pick([4, 16, 64, 64, 64, 76]))
        body = "".join(chars(b64 + "+/", width) + pick(["\n", "\n", "\\n"]) for _ in range(lines))
        return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}".rstrip() + pick(["", f"\n-----END {kind}PRIVATE KEY-----"])

    def secret() -> tuple[str, str]:
        k = int(rng.integers(10))
        v = [
            lambda: chars(hexa, int(pick([32, 40, 40, 40, 64]))), lambda: chars(b64, int(rng.integers(20, 60))), lambda: "AKIA" + chars(up + dig, 16), lambda: "ghp_" + chars(b64, 36), lambda: "sk_live_" + chars(b64, 24),
            lambda: f"xoxb-{chars(dig, 12)}-{chars(b64, 24)}", lambda: f"eyJ{chars(b64, 20)}.eyJ{chars(b64, 40)}.{chars(b64 + '_-', 43)}", lambda: chars(b64 + "+/", 40) + pick(["", "=", "=="]), lambda: chars(b64 + "!@#$%^&*", int(rng.integers(10, 24))), lambda: block(int(rng.integers(1, 30))),
        ][k]()
        if k == 9:
            return v, pick(["{v}", "key {v}", "cat key.pem {v}"]).format(v=v)
        if k in (2, 3, 4, 5, 6) and rng.random() < 0.35:
            return v, pick(["{v}", "({v})", "use {v}", "key {v}"]).format(v=v)
        return v, assign(pick(names), v)

    def harmless() -> tuple[str, str]:
        k = int(rng.integers(17))
        v = [
            lambda: chars(hexa, 40), lambda: chars(hexa, pick([32, 64, 128])), lambda: f"{chars(hexa, 8)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 12)}", lambda: chars(dig, int(rng.integers(16, 24))),
            lambda: f"{word()}{word()}_{word()}-{int(rng.integers(1, 3000))}", lambda: f"{word()}/{word()}/{word()}-{int(rng.integers(1, 3000))}.html", lambda: pick(["your-token-here", "xxxxxxxxxxxxxxxxxxxx", "changeme123", "example_password", "<token>", "${SECRET_TOKEN}", "REPLACE_WITH_YOUR_KEY_1", "abcdef1234567890abcdef", "********"]), lambda: chars(b64 + "+/", int(rng.integers(60, 200))),
            lambda: f"v{int(rng.integers(9))}.{int(rng.integers(99))}.{int(rng.integers(99))}-{word()}-{chars(dig, 8)}", lambda: f"{chars(dig, 4)}-{chars(dig, 2)}-{chars(dig, 2)}T{chars(dig, 2)}-{chars(dig, 2)}-{chars(dig, 2)}", lambda: word() + word() + word() + word() + pick(dig), lambda: pick(["a", "the", "is", "of"]) + word() + word(),
            lambda: f"{word()}.{word()}.{word()}{int(rng.integers(99))}.example.com", lambda: "get" + word().title() + word().title() + "By" + word().title() + pick(dig), lambda: chars(dig, 4) + "-" + chars(dig, 4) + "-" + chars(dig, 4) + "-" + chars(dig, 4), lambda: word() + "=" * int(rng.integers(10, 30)) + pick(dig), lambda: block(0).rsplit("\n-----END", 1)[0],
        ][k]()
        near = {0: ["commit {v}", "sha1 {v}", "revision {v}", "Merge {v}", "{v}"], 1: ["sha256:{v}", "md5 {v}", "checksum: {v}", "integrity {v}", "digest {v}"], 2: ["uuid {v}", "request id {v}", "/items/{v}/view", "trace {v}"], 3: ["{v}", "order {v}", "card {v}", "id={v}"], 6: ["#"], 7: ["data:image/png;base64,{v}", "src {v}", "image {v}"], 11: ["password {v}", "secret {v}", "token {v}", "key {v}"]}
        shape = pick(near.get(k, ["{v}", '"{v}"', "({v})", "see {v}", "https://www.{v}", "file {v}", "| {v} |"]))
        return v, assign(pick(names), v) if shape == "#" else shape.format(v=v)

    x, y = [], []
    while len(y) < n:
        label = int(rng.random() < 0.5)
        v, shown = secret() if label else harmless()
        if rng.random() < 0.12 and " " not in v:
            v, shown = (v.upper(), shown.upper()) if rng.random() < 0.6 else (v, shown.replace(" ", pick([" | ", "$$$ ", "### "])))
        line = f"{text(int(rng.integers(0, 7)))} {shown}{pick(['', '', '!!', '###', '.', ','])} {text(int(rng.integers(0, 7)))}"
        at = line.find(v)
        x.append(features(line, at, at + len(v), pick(["", "", "src3", "src/app.py", "tests/test_x.py", "docs/example.md"])))
        y.append(label)
    return np.array(x), np.array(y)


class Forest:
    """Random forest of CART trees on bootstrap samples, with the Gini index and sqrt(features) tried at each node."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, rng.integers(0, len(y), len(y)), depth, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x, y, rows, depth, rng) -> np.ndarray:
        """Nodes as rows: feature (-1: leaf), threshold, left, right, share of secrets."""
        nodes: list[list[float]] = []
        stack = [(rows, 0, -1, 0)]
        while stack:
            at, level, parent, side = stack.pop()
            me = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = me
            share = float(y[at].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if level == depth or len(at) < 4 or share in (0.0, 1.0):
                continue
            best = (np.inf, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 1), replace=False):
                order = np.argsort(x[at, f], kind="stable")
                v, t = x[at, f][order], np.cumsum(y[at][order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if len(cut):
                    left, pos = cut + 1.0, t[cut]
                    right, neg = len(at) - left, t[-1] - pos
                    gini = pos * (1 - pos / left) + neg * (1 - neg / right)
                    i = int(gini.argmin())
                    if gini[i] < best[0]:
                        best = (gini[i], f, (v[cut[i]] + v[cut[i] + 1]) / 2)
            if best[1] >= 0:
                nodes[me][:2] = [best[1], best[2]]
                low = x[at, best[1]] <= best[2]
                stack += [(at[low], level + 1, me, 0), (at[~low], level + 1, me, 1)]
        return np.array(nodes)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probability of a secret, of each row."""
        x = np.asarray(x, float).reshape(-1, len(x[0])) if len(x) else np.zeros((0, 1))
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while len(x):
                f = t[at, 0].astype(int)
                go = f >= 0
                if not go.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] > t[at, 1]
                at = np.where(go, t[at, 2 + right.astype(int)].astype(int), at)
            out += t[at, 4]
        return out / len(self.trees)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan_secrets(docs: DataFrame, text: str = "text", source: str = "source", threshold: float = 0.5, mask: str = MASK) -> DataFrame:
    """``docs`` with its secrets masked in ``text``, and n_candidates, n_secrets and secrets
    (code-point spans in the text as it was, with scores).

    Columns of those names are replaced.  Every row stays. A null or empty text has no
    candidates; a text without secrets stays as it is.  Whole texts are scanned.
    """
    names = [c for c in docs.columns if c not in ("n_candidates", "n_secrets", "secrets")]
    forest = docs.sparkSession.sparkContext.broadcast(Forest(*labelled_findings()))  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = forest.value
        for b in batches:
            at = names.index(text)
            texts = b.column(at).to_pylist()
            paths = b.column(names.index(source)).to_pylist() if source in names else [""] * len(texts)
            found = [candidates(t) if t else [] for t in texts]
            x = [features(t, s, e, str(p or "")) for t, p, c in zip(texts, paths, found) for s, e, _ in c]
            scores = iter(model(x))
            n, spans = [], []
            for i, c in enumerate(found):
                scored = [{"start": s, "end": e, "score": float(next(scores))} for s, e, _ in c]
                kept = [s for s in scored if s["score"] >= threshold]
                n.append(len(c))
                spans.append(kept)
                if kept:
                    parts, last = [], 0
                    for s in kept:
                        parts += [texts[i][last : s["start"]], mask]
                        last = s["end"]
                    texts[i] = "".join([*parts, texts[i][last:]])
            new = pa.array(texts, b.column(at).type) if any(spans) else b.column(at)
            columns = [new if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(map(len, spans), pa.int64()), pa.array(spans, _SPANS)], names=[*names, "n_candidates", "n_secrets", "secrets"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, f"{kept}n_candidates long, n_secrets long, secrets array<struct<start:long,end:long,score:double>>")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "n_candidates", "n_secrets", "secrets", "text")


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES: dict[str, str] = {}
