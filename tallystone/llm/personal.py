"""Personal data: fixed patterns and a skip-chain conditional random field.

Addresses, numbers and whatever resembles them are the tokens of a document's
field, and words between them are context. Neighbouring tokens are linked, and so
are distant ones: each token to the next one with the same letters and digits
("same"), and to the next one whose last seven digits, or name and first part of
the host, agree ("similar"). Both ends of a link share a potential for every pair
of labels, and loopy sum-product messages pass over all links, so a number that
is a telephone number in one place is one in its other spellings, too. Links join
successive occurrences, so their number grows with the tokens, not its square.

What the patterns find is observed: its label is fixed, and it speaks for its
twins. A token is added where the belief in a kind is THRESHOLD at least.

Training needs no labels: the patterns' matches in a bounded sample are the
entities. To learn links, texts are extended by other spellings of their entities
(labelled as those) and by the same spellings of altered ones (labelled as none).
The gradient is the difference of observed and believed feature counts.

Defined cases: null and empty texts have no spans; repeated rows have the same
spans; an empty table gives no rows; without any entity in the sample nothing is
added to what the patterns find; very long texts are read whole, at linear cost
(only the sample leaves out texts over MAX_CHARS); rows without a doc_id are not
learnt from; columns named as results are replaced, others are kept.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallystone.llm.common import with_arrow

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0: none of them
#: Bound of the fitted sample: documents, and characters of one.
SAMPLE, MAX_CHARS = 1500, 12_000
THRESHOLD, ROUNDS, DAMP = 0.85, 12, 0.3
#: Small samples are extended several times over, in different ways, up to so many texts.
LEAST_TEXTS, MOST_TIMES = 400, 6
CHAIN, SAME, SIMILAR = 0, 1, 2

HOST = re.compile(r"@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)")
BARE = re.compile(r"@([A-Za-z0-9-]++)")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELT = re.compile(r"(?: at | ?[(\[]at[)\]] ?)([A-Za-z0-9-]++(?:(?:\.| dot | ?[(\[](?:dot|\.)[)\]] ?)[A-Za-z0-9-]++)+)")
NUMBER = re.compile(r"\(?[0-9]++(?:[ ./_()\[\]-]{1,3}+[0-9]++)*+")
OTHERS = re.compile(r"[^0-9]+")
GROUPS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(parts) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _name_before(text: str, at: int, least: int) -> int:
    """Where the name that ends at ``at`` begins, not before ``least``."""
    while at > least and text[at - 1] in LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, by start and kind."""
    found, end = [], 0
    for m in HOST.finditer(text):
        start = _name_before(text, m.start(), end)
        if start < m.start():
            end = m.end()
            found.append((start, 0, end))
    for m in IP.finditer(text):
        if _small(m.groups()):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = OTHERS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(OTHERS.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


FEATURES = (
    ["bias", "plus", "round brackets", "square brackets", "at sign", "at in letters", "dot in letters", "host of one part", "Luhn holds", "four small parts"]
    + [f"digits {n}" for n in ("0", "1-6", "7", "8", "9", "10", "11", "12", "13-15", "16", "17-19", "more")]
    + [f"groups {n}" for n in ("1", "2", "3", "4", "more")]
    + [f"between: {n}" for n in ("nothing", "blank", "dot", "hyphen", "slash or underscore", "mixed")]
    + ["groups of four", "three, three, four at the end", "letter before", "letter after", "colon before"]
)
PLACE = {n: i for i, n in enumerate(FEATURES)}
DIGITS = np.array([0] + [1] * 6 + [2, 3, 4, 5, 6, 7, 8, 8, 8, 9, 10, 10, 10] + [11], np.int64)


@dataclass
class Token:
    start: int
    end: int
    base: int  # kind + 1 of a pattern's match, else 0
    allowed: tuple[bool, ...]
    same: str
    similar: str
    features: list[int]


def _token(text: str, start: int, end: int, base: int, address: str = "") -> Token | None:
    """The token over a span; ``address`` is the plain form of an e-mail address. None if it can be no entity."""
    form, on = text[start:end], PLACE
    digits, groups = OTHERS.sub("", form), GROUPS.findall(form)
    picks = [on["bias"], on["digits 0"] + int(DIGITS[min(len(digits), 20)])]
    if address:
        name, _, host = address.lower().partition("@")
        picks += [on["at sign"]] if "@" in form else [on["at in letters"]]
        picks += [on["dot in letters"]] if "." in host and "." not in form[len(name) :] else []
        picks += [on["host of one part"]] if "." not in host else []
        allowed, same, similar = (True, True, False, False, False), f"a{name}@{host}", f"a{name}@{host.partition('.')[0]}"
    else:
        four = len(groups) == 4 and _small(groups)
        allowed = (True, False, four, 12 <= len(digits) <= 19, 7 <= len(digits) <= 15)
        if not base and not any(allowed[1:]):
            return None
        between = set(OTHERS.sub(lambda m: m.group()[:3], "".join(OTHERS.findall(form.strip("+()"))))) if len(groups) > 1 else set()
        named = {" ": "blank", ".": "dot", "-": "hyphen", "/": "slash or underscore", "_": "slash or underscore"}
        kinds = {named.get(c, "mixed") for c in between}
        picks.append(on["between: nothing"] if not kinds else on["between: " + (kinds.pop() if len(kinds) == 1 else "mixed")])
        picks.append(on["groups 1"] + min(len(groups), 5) - 1)
        picks += [on["Luhn holds"]] if 12 <= len(digits) <= 19 and luhn(digits) else []
        picks += [on["four small parts"]] if four else []
        picks += [on["groups of four"]] if len(groups) > 1 and all(len(g) == 4 for g in groups) else []
        picks += [on["three, three, four at the end"]] if [len(g) for g in groups[-3:]] == [3, 3, 4] else []
        same, similar = ("i" + ".".join(str(int(g)) for g in groups) if four else f"n{digits}"), f"n{digits[-7:]}" if len(digits) >= 7 else ""
    picks += [on["plus"]] if form.startswith("+") else []
    picks += [on["round brackets"]] if "(" in form else []
    picks += [on["square brackets"]] if "[" in form else []
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    picks += [on["letter before"]] if before.isalpha() else []
    picks += [on["letter after"]] if after.isalpha() else []
    picks += [on["colon before"]] if text[max(0, start - 2) : start].strip() == ":" else []
    if base:
        allowed = tuple(a or k == base for k, a in enumerate(allowed))
    return Token(start, end, base, allowed, same, similar, picks)


def _plain_host(spelt: str) -> str:
    return re.sub(r" dot | ?[(\[](?:dot|\.)[)\]] ?", ".", spelt)


def tokens(text: str, base: list[tuple[int, int, int]]) -> list[Token]:
    """The field's tokens in order: the patterns' matches, and all else that may be an entity."""
    found = [_token(text, s, e, k + 1, text[s:e] if k == 0 else "") for s, k, e in base]
    spans = []
    end = 0
    for m in BARE.finditer(text):
        start = _name_before(text, m.start(), end)
        if start < m.start():
            end = m.end()
            spans.append((start, end, text[start:end]))
    end = 0
    for m in SPELT.finditer(text):
        start = _name_before(text, m.start(), end)
        if start < m.start():
            end = m.end()
            spans.append((start, end, f"{text[start:m.start()]}@{_plain_host(m.group(1))}"))
    spans += [(m.start() + (m.group().startswith("(") and ")" not in m.group()), m.end(), "") for m in NUMBER.finditer(text) if m.end() - m.start() >= 7]
    # What a pattern has found is not looked at again; both lists are in order of their starts.
    taken, i, reach = sorted((s, e) for s, _, e in base), 0, 0
    for start, end, address in sorted(spans):
        while i < len(taken) and taken[i][0] < end:
            reach, i = max(reach, taken[i][1]), i + 1
        if start >= reach and (t := _token(text, start, end, 0, address)):
            found.append(t)
            reach = end
    return sorted(found, key=lambda t: (t.start, t.base))


@dataclass
class Field:
    """Tokens of many documents: features, allowed labels, and links (from, to, type)."""

    tokens: list[list[Token]]
    rows: np.ndarray
    picks: np.ndarray
    allowed: np.ndarray
    base: np.ndarray
    links: np.ndarray


def field(documents: list[list[Token]]) -> Field:
    rows, picks, allowed, base, links, n = [], [], [], [], [], 0
    for doc in documents:
        last: dict = {}
        for i, t in enumerate(doc):
            if i:
                links.append((n - 1, n, CHAIN))
            joined = set()
            for kind, key in ((SAME, t.same), (SIMILAR, t.similar)):
                # Equal tokens have one link, of the stronger type.
                if key and (other := last.get((kind, key))) is not None and other not in joined:
                    links.append((other, n, kind))
                    joined.add(other)
                last[kind, key] = n
            rows += [n] * len(t.features)
            picks += t.features
            allowed.append(t.allowed)
            base.append(t.base)
            n += 1
    return Field(documents, np.array(rows, np.int64), np.array(picks, np.int64), np.array(allowed, bool).reshape(n, LABELS), np.array(base, np.int64), np.array(links, np.int64).reshape(-1, 3))


@dataclass
class Model:
    weights: np.ndarray  # (features, labels); label 0 has none
    shared: np.ndarray  # (link types, labels, labels)

    def own(self, f: Field) -> np.ndarray:
        out = np.zeros((len(f.base), LABELS))
        for k in range(1, LABELS):
            out[:, k] = np.bincount(f.rows, self.weights[f.picks, k], len(f.base))
        return np.where(f.allowed, out, -1e4)

    def beliefs(self, f: Field, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beliefs of tokens and of links, by damped messages over all links at once."""
        a, b, kind = f.links.T
        power = np.exp(self.shared[kind])
        to_b, to_a = np.zeros((len(a), LABELS)), np.zeros((len(a), LABELS))

        def gathered():
            out = own.copy()
            for k in range(LABELS):
                out[:, k] += np.bincount(b, to_b[:, k], len(own)) + np.bincount(a, to_a[:, k], len(own))
            return out

        def normal(x):
            x = np.exp(x - x.max(1, keepdims=True))
            return x / x.sum(1, keepdims=True)

        for _ in range(ROUNDS if len(a) else 0):
            now = gathered()
            new_b = np.log(np.maximum(np.einsum("ei,eij->ej", normal(now[a] - to_a), power), 1e-30))
            new_a = np.log(np.maximum(np.einsum("ej,eij->ei", normal(now[b] - to_b), power), 1e-30))
            change = 0.0
            for old, new in ((to_b, new_b), (to_a, new_a)):
                new -= new.max(1, keepdims=True)
                step = (1 - DAMP) * (new - old)
                change = max(change, float(np.abs(step).max(initial=0)))
                old += step
            if change < 1e-4:
                break
        now = gathered()
        pair = normal(now[a] - to_a)[:, :, None] * power * normal(now[b] - to_b)[:, None, :]
        return normal(now), pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)

    def added(self, f: Field) -> list[tuple[int, int]]:
        """(token, kind) of tokens outside the patterns' matches that are entities."""
        if not len(f.base):
            return []
        own = self.own(f)
        seen = np.flatnonzero(f.base)
        own[seen] = -1e4
        own[seen, f.base[seen]] = 0
        belief, _ = self.beliefs(f, own)
        belief[:, 0] = 0
        best = belief.argmax(1)
        hit = np.flatnonzero((f.base == 0) & (belief.max(1) >= THRESHOLD))
        return [(int(i), int(best[i]) - 1) for i in hit]


def _respelt(kind: int, form: str, rng: random.Random) -> str:
    """Another spelling of an entity, one that the patterns do not find."""
    if kind == 0:
        name, _, host = form.partition("@")
        return rng.choice([f"{name} at {host}", f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} at {host.replace('.', ' dot ')}", f"{name}@{host.partition('.')[0]}"])
    groups = GROUPS.findall(form)
    if kind == 1:
        return rng.choice(["[.]", " . ", "(.)", "-"]).join(groups)
    digits = "".join(groups)
    if kind == 2:
        return rng.choice([".", "/", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:] if len(digits) > 10 and rng.random() < 0.5 else digits
    cut = [tail[:-7], tail[-7:-4], tail[-4:]]
    return rng.choice([" ".join(cut), ".".join(cut), "-".join(cut), f"({cut[0]}) {cut[1]}-{cut[2]}", tail, f"{cut[1]}-{cut[2]}"])


def _altered(form: str, rng: random.Random) -> str:
    return "".join(rng.choice("0123456789") if c.isdigit() else rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isascii() and c.isalpha() else c for c in form)


def extended(text: str, seed: int) -> tuple[list[Token], list[int]]:
    """Tokens and labels of a training text: its own, then other spellings of its entities and of altered ones."""
    rng, base = random.Random(seed), base_spans(text)
    words = re.findall(r"[^\W\d_]+", text[:2000]) or ["word"]
    parts, at, marks = [text], len(text), []
    # Strangers are more than twins, stand in any order and are repeated, so that neither a form nor a place nor mere repetition gives an entity away.
    wanted: list[tuple[str, int]] = []
    for s, k, e in base[:40]:
        if rng.random() < 0.75:
            wanted.append((_respelt(k, text[s:e], rng), k + 1))
        for _ in range(2):
            strange = _altered(text[s:e], rng)
            wanted += [(strange if k in (1, 2) and rng.random() < 0.5 else _respelt(k, strange, rng), 0)] * rng.choice((0, 1, 1, 2, 5))
    rng.shuffle(wanted)
    for form, label in wanted:
        lead = "\n" + " ".join(rng.choices(words, k=rng.randint(3, 8))) + " "
        parts += [lead, form, ", " + rng.choice(words) + "."]
        marks.append((at + len(lead), at + len(lead) + len(form), label))
        at += sum(map(len, parts[-3:]))
    whole = "".join(parts)
    found = base_spans(whole)
    doc = tokens(whole, found)
    # An altered or respelt form may happen to be a pattern's match: that is its label then.
    labels = [t.base or next((y for a, b, y in marks if a <= t.start < b), 0) for t in doc]
    kept = [(t, y) for t, y in zip(doc, labels, strict=True) if t.allowed[y]]
    return [t for t, _ in kept], [y for _, y in kept]


def fit(texts: list[str], steps: int = 150, l2: float = 1e-4) -> Model:
    """Adam on the field's likelihood, with beliefs in place of expected counts."""
    model = Model(np.zeros((len(FEATURES), LABELS)), np.zeros((3, LABELS, LABELS)))
    times = min(MOST_TIMES, max(1, -(-LEAST_TEXTS // max(1, len(texts)))))
    made = [extended(t, i) for i, t in enumerate(texts * times)]
    f = field([doc for doc, _ in made])
    y = np.array([v for _, labels in made for v in labels], np.int64)
    if not y.any():
        model.weights[PLACE["bias"], 1:] = -30
        return model
    truth = np.eye(LABELS)[y]
    a, b, kind = f.links.T
    pairs = truth[a][:, :, None] * truth[b][:, None, :]
    place = f.picks * len(KINDS)
    weights, shared = model.weights, model.shared
    mean, spread = [np.zeros_like(weights), np.zeros_like(shared)], [np.zeros_like(weights), np.zeros_like(shared)]
    for t in range(1, steps + 1):
        belief, pair = model.beliefs(f, model.own(f))
        gap = (truth - belief)[f.rows, 1:]
        grown = np.zeros_like(weights)
        for k in range(len(KINDS)):
            grown[:, k + 1] = np.bincount(place + k, gap[:, k], len(FEATURES) * len(KINDS)).reshape(-1, len(KINDS))[:, k]
        linked = np.stack([(pairs - pair)[kind == c].sum(0) for c in range(3)])
        for i, (p, g) in enumerate(((weights, grown), (shared, linked))):
            g = g / len(y) - l2 * p
            mean[i] = 0.9 * mean[i] + 0.1 * g
            spread[i] = 0.99 * spread[i] + 0.01 * g * g
            p += 0.15 * (mean[i] / (1 - 0.9**t)) / (np.sqrt(spread[i] / (1 - 0.99**t)) + 1e-8)
    return model


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on SAMPLE texts at most, those with the smallest hashes of their ids among texts that may hold an entity."""
    body, key = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("string")
    rows = documents.select(key.alias("i"), body.alias("t")).where((F.length("t") <= MAX_CHARS) & F.col("i").isNotNull())
    likely = rows.where(F.col("t").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9]\.[0-9]{1,3}\.[0-9]|[0-9]{12}"))
    picked = likely.select("i").groupBy("i").agg(F.first(F.xxhash64("i")).alias("h")).orderBy("h", "i").limit(SAMPLE)
    # SAMPLE ids at most; a repeated id has one text, so the driver's copy keeps its bound.
    got = likely.join(F.broadcast(picked), "i").groupBy("i").agg(F.min("t").alias("t")).collect()
    return fit([r["t"] for r in sorted(got, key=lambda r: r["i"])])


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def spans_of(texts: list[str], model: Model) -> list[list[dict]]:
    """All spans of every text, by start and kind."""
    base = [base_spans(t) for t in texts]
    docs = [tokens(t, b) for t, b in zip(texts, base, strict=True)]
    found = [[(s, k, e, True) for s, k, e in b] for b in base]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs]).tolist()
    flat = [t for d in docs for t in d]
    for i, k in model.added(field(docs)):
        found[owner[i]].append((flat[i].start, k, flat[i].end, False))
    return [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in sorted(doc)] for doc in found]


def find(documents: DataFrame, model: Model, text: str = "text", name: str = "spans") -> DataFrame:
    """Append ``name``: kind, start, end (code points, exclusive) and whether a pattern found it."""
    return with_arrow(documents, text, [(name, SPAN, ARROW_SPAN)], lambda: lambda texts: [spans_of(texts, model)])


def redact(documents: DataFrame, model: Model, text: str = "text", name: str = "redacted") -> DataFrame:
    """Append ``name``: the text with every run of overlapping spans replaced by its first kind in brackets."""

    def one(value: str, spans: list[dict]) -> str:
        out, at = [], 0
        for s in spans:
            if s["start"] >= at:
                out += [value[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        return "".join([*out, value[at:]])

    return with_arrow(documents, text, [(name, T.StringType(), pa.string())], lambda: lambda texts: [[one(t, s) for t, s in zip(texts, spans_of(texts, model), strict=True)]])


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def report(documents: DataFrame) -> DataFrame:
    """The contract's columns; counts are those of the patterns' spans, ``n_added`` of the field's."""
    found = find(documents.select("doc_id", "text"), train(documents))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)
