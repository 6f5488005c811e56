"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The patterns give the base spans. The field labels tokens with digits or an at-sign. Neighbours in
the text share a chain potential, and repeats of the same address or number share a skip
potential with a hub, so that they are two steps apart wherever they stand; loopy message passing
makes their labels agree. It is
trained by pseudo-likelihood on tokens labelled by the base patterns, with the patterns' own
evidence hidden from half of them, so that form, neighbours and repeats must speak.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adapterlens.llm.common import batch_column, bounded_sample, fresh, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
#: Documents sampled for training (about as many; a tenth of them hold digits), and tokens at most.
TRAIN_DOCS, TRAIN_TOKENS = 20_000, 20_000
#: Marginal probability from which the field's label adds a span.
SURE = 0.9
#: Messages pass until none changes by more than this. The share of the old message that is kept
#: grows by a part every so many rounds, so that loops that swing settle too.
SETTLED, DAMPING, PATIENCE = 1e-4, 0.3, 100

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is always matched from its first one, so starts inside a run need no try.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: A token that can be a part of a number written with spaces.
PART = re.compile(r"[(+]*[0-9][0-9().-]*")
#: Digits that two forms of a number share at its end, at least, and digits of a number at most.
TAIL, MOST_DIGITS = 7, 19
#: Digits of a country code at most.
COUNTRY = 3
EDGE = "\"'()[]{}<>,;:!?#*$%&|."

Span = tuple[int, int, str]


def byte(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 4 and int(digits or 0) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start and kind: leftmost, non-overlapping per kind; failing ones dropped."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(byte, m[0].split(".")))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((*m.span(), "card"))
        if "+" in text:
            found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _bucket(n: int, *edges: int) -> int:
    return sum(n >= e for e in edges)


def token_features(token: str, before: str, after: str) -> list[str]:
    """What the field sees of a token: its form and that of its neighbours."""
    core = token.strip(EDGE)
    groups = [g for g in NOT_DIGIT.split(core) if g]
    digits = "".join(groups)
    letters = any(c.isalpha() for c in core)
    out = [
        f"digits={_bucket(len(digits), 1, 4, 7, 9, 12, 16, 17, 20)}",
        f"groups={min(len(groups), 5)}",
        f"widest={_bucket(max(map(len, groups), default=0), 1, 2, 3, 4, 5, 7, 12, 16, 17)}",
        f"dots={min(core.count('.'), 4)}",
        f"at={min(core.count('@'), 2)}{'.' in core.partition('@')[2]}",
        f"letters={letters}",
        f"plus={token.startswith('+')}",
        f"paren={'(' in token}",
        f"dash={min(core.count('-'), 3)}",
        f"before={'d' if DIGIT.search(before) else 'w'}{'+' if before.startswith('+') else ''}",
        f"after={'d' if DIGIT.search(after) else 'w'}{'(' if after.startswith('(') else ''}",
    ]
    if not letters and len(groups) == 4 and core.count(".") == 3:
        out.append(f"quad={all(map(byte, groups))}")
    if not letters and 12 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    return [*out, f"{out[0]},{out[1]},{out[5]}"]


def token_key(token: str) -> str | None:
    """What repeats and similar tokens have in common: the address, or the last seven digits."""
    core = token.strip(EDGE).lower()
    if "@" in core:
        return core
    digits = NOT_DIGIT.sub("", core)
    return digits[-TAIL:] if len(digits) >= TAIL else None


def numbers(text: str, places: list[tuple[int, int]], spans: list[Span]) -> dict[int, int]:
    """First -> last token of the numbers that are written over several tokens.

    They are the tokens of a base span, and neighbouring ones whose joined digits are those of a
    base span of the text or end alike, one being a whole suffix of the other. A token before
    those of the base span is not part of the number; behind one, only a country code may lack.
    """
    out: dict[int, int] = {}
    known: dict[str, set[str]] = {}
    starts = [a for a, _ in places]
    done = -1
    for a, b, kind in spans:
        if kind in ("card", "phone"):
            digits = NOT_DIGIT.sub("", text[a:b])
            known.setdefault(digits[-TAIL:], set()).add(digits)
            first, last = bisect_right(starts, a) - 1, bisect_left(starts, b) - 1
            if first > done and last > first:
                out[first] = done = last
    if not known:
        return out
    i = 0
    while i < len(places):
        if i in out:
            i = out[i] + 1
            continue
        digits, lead, best, k = "", 0, None, i
        spare = COUNTRY if i and PART.fullmatch(text[slice(*places[i - 1])]) else MOST_DIGITS
        while k < len(places) and k not in out and len(digits) <= MOST_DIGITS:
            word = text[slice(*places[k])]
            if not PART.fullmatch(word.strip(EDGE) if k == i else word.rstrip(EDGE)):
                break
            digits += NOT_DIGIT.sub("", word)
            lead = lead or len(digits)
            ends = known.get(digits[-TAIL:], ()) if k > i else ()
            if any(x.endswith(digits) and len(x) - len(digits) <= spare or digits.endswith(x) and len(digits) - len(x) < lead for x in ends):
                best = k
            if word[-1] in ",;:!?":
                break
            k += 1
        if best is not None:
            out[i] = best
            i = best
        i += 1
    return out


def graph(texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Candidate tokens of the texts, their chain edges (pairs of token numbers) and their skip
    edges (token number, hub number).

    A token is (text number, start, end, features, base label or 0); a number written over several
    words is one. Each key that a text
    repeats has one hub, joined to all tokens of that key, so many repeats cost one edge each.
    """
    tokens, chain, skip, n_hubs = [], [], [], 0
    for n, text in enumerate(texts):
        if not text or not CANDIDATE.search(text):
            continue
        spans = base_spans(text)
        places = [m.span() for m in TOKEN.finditer(text)]
        places_of: dict[str, list[int]] = {}
        was, s = -2, 0
        whole, passed = numbers(text, places, spans), -1
        for i, (a, b) in enumerate(places):
            if i <= passed:
                continue
            passed = whole.get(i, i)
            b = places[passed][1]
            word = text[a:b]
            if word.isalpha() or not CANDIDATE.search(word):
                continue
            while s < len(spans) and max(x[1] for x in spans[s : s + 1]) <= a:
                s += 1
            label = next((LABELS.index(k) for x, y, k in spans[s : s + 4] if x < b and y > a), 0)
            before = text[slice(*places[i - 1])] if i else ""
            after = text[slice(*places[passed + 1])] if passed + 1 < len(places) else ""
            me = len(tokens)
            tokens.append((n, a, b, token_features(word, before, after), label))
            if was == i - 1:
                chain.append((me - 1, me))
            was = passed
            key = token_key(word)
            if key:
                places_of.setdefault(key, []).append(me)
        for same in places_of.values():
            if len(same) > 1:
                skip += [(me, n_hubs) for me in same]
                n_hubs += 1
    pairs = lambda e: np.array(e, dtype=np.int64).reshape(-1, 2)
    return tokens, pairs(chain), pairs(skip)


def repeats(skip: np.ndarray) -> np.ndarray:
    """Pairs of tokens that follow one another at a hub, for the fit."""
    by_hub = skip[np.lexsort((skip[:, 0], skip[:, 1]))]
    same = by_hub[1:, 1] == by_hub[:-1, 1]
    return np.column_stack([by_hub[:-1, 0][same], by_hub[1:, 0][same]])


class Field:
    """Weights of the skip-chain field; plain arrays, a few kilobytes."""

    def __init__(self, names: dict[str, int], node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.names, self.node, self.chain, self.skip = names, node, chain, skip

    def logits(self, tokens: list[tuple]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for i, (_, _, _, seen, base) in enumerate(tokens):
            ids = [self.names[f] for f in [*seen, f"base={base}" if base else "base=hidden"] if f in self.names]
            out[i] = self.node[ids].sum(axis=0)
            if base:
                out[i, base] += 20  # the patterns' own spans stand
        return out

    def beliefs(self, tokens: list[tuple], chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Marginals of tokens with skip edges to hubs, as `graph` gives them.

        A hub holds the labels that the patterns gave to its tokens, so that evidence reaches
        every repeat by one potential; what else the tokens tell comes by two. The potential
        counts once for a key of two tokens and twice for more, as a repeat has one or two
        neighbours in the fit.
        """
        hubs = int(skip[:, 1].max()) + 1 if len(skip) else 0
        strength = np.minimum(np.bincount(skip[:, 1], minlength=hubs)[skip[:, 1]] - 1, 2)
        known = np.zeros((hubs, len(LABELS)))
        for t, h in skip.tolist():
            if tokens[t][4]:
                known[h, tokens[t][4]] = 20
        return self.marginals(tokens, chain, skip + [0, len(tokens)], known, strength)[: len(tokens)]

    def marginals(self, tokens: list[tuple], chain: np.ndarray, skip: np.ndarray, hubs: np.ndarray | None = None, strength: np.ndarray | None = None) -> np.ndarray:
        """Sum-product messages both ways over all edges at once, until they settle.

        Each text settles by itself: its messages stop when they change no more, whatever the others in
        the batch do, so its marginals do not depend on them. hubs: own scores of the variables that
        follow the tokens; strength: how often each skip edge's potential counts.
        """
        own = self.logits(tokens)
        own = own if hubs is None else np.concatenate([own, hubs])
        edges = np.concatenate([chain, skip])
        if not len(edges):
            return _softmax(own)
        kind = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0) * (1 if strength is None else strength[:, None, None])])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        weight = np.concatenate([kind, kind.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        # No edge joins two texts, so an edge's text is that of its end that is a token.
        text = np.array([t[0] if t else 0 for t in tokens])[np.concatenate([edges[:, 0], edges[:, 0]])]
        message = np.zeros((len(source), len(LABELS)))
        rounds, moving = 0, np.arange(len(source))
        while len(moving):
            keep = 1 - (1 - DAMPING) / (1 + rounds // PATIENCE)
            if keep > 0.99:  # no fixed point in reach: the average of the swing stands
                break
            belief = own.copy()
            np.add.at(belief, target[moving], message[moving])
            out = belief[source[moving]] - message[back[moving]]
            new = np.logaddexp.reduce(out[:, :, None] + weight[moving], axis=1)
            new -= new.max(axis=1, keepdims=True)
            change = np.zeros(text.max() + 1)
            np.maximum.at(change, text[moving], np.abs(new - message[moving]).max(axis=1))
            message[moving] = keep * message[moving] + (1 - keep) * new
            moving, rounds = moving[change[text[moving]] > SETTLED], rounds + 1
        belief = own.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_field(seen: list[list[str]], labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 300) -> Field:
    """Pseudo-likelihood by gradient steps: each token given its neighbours' labels.

    seen: features per token; chain, skip: edges. Without tokens all labels stay `other`.
    """
    count: dict[str, int] = {}
    for fs in seen:
        for f in fs:
            count[f] = count.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, c in count.items() if c >= 3))}
    k, n = len(LABELS), len(seen)
    x = np.zeros((n, len(names) + 1))
    for i, fs in enumerate(seen):
        x[i, [names[f] for f in fs if f in names]] = 1
    x[:, -1] = 1
    one = np.eye(k)[labels]

    def around(edges: np.ndarray, up: bool) -> np.ndarray:
        out = np.zeros((n, k))
        a, b = (edges[:, 0], edges[:, 1]) if up else (edges[:, 1], edges[:, 0])
        np.add.at(out, b, one[a])
        return out

    left, right = around(chain, True), around(chain, False)
    same = around(skip, True) + around(skip, False)
    w, c, s = np.zeros((x.shape[1], k)), np.zeros((k, k)), np.zeros((k, k))
    w[-1, 0] = 2.0
    if n:
        speed = [np.zeros_like(v) for v in (w, c, s)]
        for _ in range(steps):
            p = _softmax(x @ w + left @ c + right @ c.T + same @ s)
            g = (one - p) / n
            steps_ = (x.T @ g - 1e-4 * w, left.T @ g + (right.T @ g).T - 1e-3 * c, same.T @ g - 1e-3 * s)
            for v, grad, m in zip((w, c, s), steps_, speed, strict=True):
                m *= 0.9
                m += grad
                v += 2.0 * m
            s[:] = (s + s.T) / 2
    names["bias"] = len(names)
    return Field(names, w, c, s)


def train_field(docs: DataFrame, most_docs: int = TRAIN_DOCS, most_tokens: int = TRAIN_TOKENS) -> Field:
    """Fit the field on a bounded sample: about `most_docs` texts, of which `most_tokens` tokens at most.

    Tasks turn the sampled texts into tokens with features and edges; only these come to the driver,
    in the order of a hash of their document, so that the fit is the same however rows are dealt.
    Repeated rows count once. Null texts have no tokens.
    """
    picked = bounded_sample(docs.select("doc_id", "text"), most_docs, "doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    picked = picked.select(F.xxhash64(F.lit("order"), "doc_id", "text").alias("h"), "text").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, chain, skip = graph(batch.column("text").to_pylist())
            before: list[list[list[int]]] = [[[], []] for _ in tokens]
            for at, edges in enumerate((chain, repeats(skip))):
                for a, b in edges.tolist():
                    before[b][at].append(b - a)
            hashes = batch.column("h").to_pylist()
            for at in range(0, len(tokens), 4096):
                rows = [{"h": hashes[t[0]], "at": t[1], "seen": t[3], "label": t[4], "chain": e[0], "skip": e[1]} for t, e in zip(tokens[at : at + 4096], before[at : at + 4096], strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("h", pa.int64()), ("at", pa.int64()), ("seen", pa.list_(pa.string())), ("label", pa.int32()), ("chain", pa.list_(pa.int64())), ("skip", pa.list_(pa.int64()))])
    found = picked.mapInArrow(run, "h bigint, at bigint, seen array<string>, label int, chain array<bigint>, skip array<bigint>")
    rows = found.orderBy("h", "at").limit(most_tokens).collect()
    labels = np.array([r.label for r in rows], dtype=np.int64)
    seen = []
    for i, r in enumerate(rows):
        hidden = zlib.crc32(f"{i}:{'|'.join(r.seen)}".encode()) % 2 or not r.label
        seen.append([*r.seen, "base=hidden" if hidden else f"base={r.label}"])
    edges = lambda at: np.array([(i - d, i) for i, r in enumerate(rows) for d in r[at] if d <= i], dtype=np.int64).reshape(-1, 2)
    return fit_field(seen, labels, edges("chain"), edges("skip"))


def added_spans(texts: list[str], field: Field, sure: float = SURE) -> list[list[Span]]:
    """For each text the spans that the field adds: runs of neighbouring tokens of one surely
    labelled kind that touch no base span, without the punctuation around them."""
    out: list[list[Span]] = [[] for _ in texts]
    tokens, chain, skip = graph(texts)
    if not tokens:
        return out
    p = field.beliefs(tokens, chain, skip)
    best = p.argmax(axis=1)
    joined = {b: a for a, b in chain.tolist()}
    for i, (n, a, b, _, base) in enumerate(tokens):
        if base or not best[i] or p[i, best[i]] < sure:
            continue
        word = texts[n][a:b]
        lead, trail = len(word) - len(word.lstrip(EDGE)), len(word) - len(word.rstrip(EDGE))
        if lead == len(word):
            continue
        a, b, kind = a + lead, b - trail, LABELS[best[i]]
        prior = joined.get(i)
        if kind == "phone" and prior is not None and out[n] and out[n][-1][2] == kind and best[prior] == best[i] and tokens[prior][1] <= out[n][-1][1] <= tokens[prior][2]:
            out[n][-1] = (out[n][-1][0], b, kind)
        else:
            out[n].append((a, b, kind))
    return out


RESULT = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string,redacted:string>"


def spans_column(field: Field, redact: bool = False):
    """A column function: text -> struct of counts, digest, spans and, if asked for, the redacted text."""

    def run(texts: list[str | None]) -> list[dict]:
        texts = [t or "" for t in texts]
        out = []
        for text, more in zip(texts, added_spans(texts, field), strict=True):
            base = base_spans(text)
            spans = sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))
            row = {f"n_{k}": sum(s[2] == k for s in base) for k in KINDS}
            row |= {"base_sha256": hashlib.sha256(written(base).encode()).hexdigest(), "spans": written(spans)}
            out.append(row | {"redacted": redacted(text, spans) if redact else None})
        return out

    return batch_column(run, RESULT)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    parts, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (base and added, `kind:start:end`, comma-joined).

    Without a field, one is trained on a bounded sample of the same documents. A null text is
    empty: no spans, the digest of the empty string. Repeated rows are searched each. Further
    columns are ignored. Empty in, empty out.
    """
    field = train_field(docs) if field is None else field
    found = docs.select("doc_id", spans_column(field)("text").alias("r"))
    return found.select("doc_id", *[f"r.n_{k}" for k in KINDS], "r.base_sha256", "r.spans")


def without_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """All rows and columns of docs(text, n_chars, ...), with each span of personal data in `text`
    replaced by its kind in brackets, and `n_chars` counted anew.

    A null text stays null, with a null n_chars. Repeated rows are treated alike. Further columns
    pass whatever their names. Empty in, empty out.
    """
    found = spans_column(train_field(docs) if field is None else field, redact=True)
    own = fresh("found", docs)
    clean = docs.withColumn(own, found("text")).withColumn("text", F.when(F.col("text").isNotNull(), F.col(f"{own}.redacted")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select([f"`{c}`" for c in docs.columns])


def op10_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of every document. Nulls, empty, long and repeated texts: as `find_personal_data` says."""
    return find_personal_data(table(spark, sf_dir, "documents"))
