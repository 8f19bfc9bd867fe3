"""Personal data: fixed base patterns, and a semi-Markov conditional random field for what they leave.

The field scores whole candidate spans (shape, check digits, length, borders, cue words) and a dynamic programme
over segments of bounded length picks boundaries and kinds together. It runs only on stretches around digits,
at-signs, key prefixes and key names with their sign, which every entity of its kinds holds. Its weights are fitted
by maximum likelihood on generated, seeded sentences, so no label of any table is used. Base spans always stay; the field adds spans where no base span lies, for example a telephone number whose
base match ran on into the next number and failed.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, slices

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
BASE_KINDS = KINDS[:4]
#: An entity spans at most so many letters; only a secret after a key name may be of any length.
MAX_LETTERS = 96

# The base patterns of the query's contract. The look-behinds and possessive repeats only spare
# starts that must fail, so that long runs of digits take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

KEY = r"(?:password|passwd|pwd|secret|token|api_?key)\s?[=:]"
SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9]){12,18}"),
    "phone": re.compile(r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "secret": re.compile(rf"(?:AKIA[A-Z0-9]{{16}}|{KEY}\s?[^\s,;]{{5,}}[A-Za-z0-9])", re.IGNORECASE),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
CUES = re.compile(r"(?:e-?mail|ip|card|visa|tel|phone|call|fax|iban|account|key|login|ssn|social)\W{0,3}$", re.IGNORECASE)
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|[^0-9A-Za-z\s]")
#: Where a kind's shape begins at all, wherever it may end.
STARTS = {kind: re.compile(f"(?={shape.pattern})", shape.flags) for kind, shape in SHAPES.items()}
#: A day, which is no telephone number.
DAY = re.compile(r"(?:19|20)[0-9]{2}[-. ](?:0[1-9]|1[0-2])[-. ](?:0[1-9]|[12][0-9]|3[01])(?![0-9])|(?:0[1-9]|[12][0-9]|3[01])[-. ](?:0[1-9]|1[0-2])[-. ](?:19|20)[0-9]{2}(?![0-9])")
MARK = re.compile(rf"[0-9@]+|AKIA|(?i:{KEY})\s?[^\s,;]*+")
#: Ten digits in the usual three groups, with one separator.
GROUPED = re.compile(r"[0-9]{3}([-. ])[0-9]{3}\1[0-9]{4}")
N_SPAN, N_OUT = 10, 4


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), leftmost and not overlapping within a kind."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def valid(kind: str, span: str) -> bool:
    """The kind's check over the whole span."""
    d = digits(span)
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15 and (span[0] == "+" or not span.isdigit()) and not DAY.match(span)
    if kind == "iban":
        s = span.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "ssn":
        return span[:3] not in ("000", "666") and span[0] != "9" and span[4:6] != "00" and span[7:] != "0000"
    if kind == "secret":
        # a value without digits counts where it is long and no blank sets it off, as prose would
        return span.startswith("AKIA") or any(c.isdigit() for c in span) or bool(re.search(r"[=:]\S{10,}$", span))
    return True


def span_features(kind: str, text: str, a: int, b: int) -> list[float]:
    span, left, right = text[a:b], text[a - 1 : a], text[b : b + 1]
    ok = valid(kind, span)
    return [
        1.0,
        float(ok),
        float(not ok),
        float(not left or not (left.isalnum() or left in "+@.-_/")),
        float(not right or not (right.isalnum() or right in "@_/")),
        float(bool(CUES.search(text, max(0, a - 12), a))),
        float(kind == "phone" and span[0] == "+"),
        float(any(c in span for c in "-(")),
        float(kind == "phone" and bool(GROUPED.fullmatch(span))),
        math.log1p(b - a),
    ]


def out_features(token: str) -> list[float]:
    return [1.0, float(token[0].isdigit()), float(token.isalpha()), math.log1p(len(token)) if token[0].isdigit() else 0.0]


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text about digits, at-signs and keys with their values, each wide enough for any entity that holds them."""
    low = high = -1
    for m in MARK.finditer(text):
        a, b = max(0, m.start() - MAX_LETTERS), min(len(text), m.end() + MAX_LETTERS)
        if high >= 0 and a <= high:
            high = max(high, b)
            continue
        if high >= 0:
            yield low, high
        low, high = a, b
    if high >= 0:
        yield low, high


def lattice(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Tokens of text[a:b], and candidate segments (first token, token after the last, kind's number).

    A secret reaches as far as its shape does; of other kinds each end within MAX_LETTERS is a candidate. Shapes are
    looked for by themselves first, so a stretch that none of them fits takes no other work.
    """
    begun = [(m.start(), k) for k, kind in enumerate(KINDS) for m in STARTS[kind].finditer(text, a, b)]
    if not begun:
        return [], []
    tokens = [m.span() for m in TOKEN.finditer(text, a, b)]
    first = {start: i for i, (start, _) in enumerate(tokens)}
    after = {end: j + 1 for j, (_, end) in enumerate(tokens)}
    segments, secret_end = [], a
    for start, k in sorted(begun):
        i, kind = first.get(start), KINDS[k]
        if i is None:
            continue
        if kind == "secret":
            # key names inside a value belong to it
            if start >= secret_end and (m := SHAPES[kind].match(text, start, b)) and m.end() in after:
                segments.append((i, after[m.end()], k))
                secret_end = m.end()
            continue
        limit = min(b, start + MAX_LETTERS)
        for j in range(i, len(tokens)):
            end = tokens[j][1]
            if end > limit:
                break
            if SHAPES[kind].fullmatch(text, start, end):
                segments.append((i, j + 1, k))
    return tokens, segments


def potentials(text: str, tokens: list, segments: list) -> tuple[np.ndarray, np.ndarray]:
    outside = np.array([out_features(text[s:e]) for s, e in tokens]).reshape(-1, N_OUT)
    inside = np.zeros((len(segments), N_SPAN))
    for n, (i, j, k) in enumerate(segments):
        inside[n] = span_features(KINDS[k], text, tokens[i][0], tokens[j - 1][1])
    return outside, inside


def best_segments(n: int, segments: list, out_score: np.ndarray, in_score: np.ndarray) -> list[int]:
    """Viterbi over segments: which of them the best division of n tokens holds."""
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, j, _) in enumerate(segments):
        ending[j].append(s)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1] + out_score[j - 1]
        for s in ending[j]:
            if (x := best[segments[s][0]] + in_score[s]) > best[j]:
                best[j], back[j] = x, s
    chosen, j = [], n
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            chosen.append(back[j])
            j = segments[back[j]][0]
    return chosen[::-1]


def marginals(n: int, segments: list, out_score: np.ndarray, in_score: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward over segments: the odds of each token outside and of each segment, and the log sum."""
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j, _) in enumerate(segments):
        ending[j].append(s)
        starting[i].append(s)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1] + out_score[j - 1], *(ahead[segments[s][0]] + in_score[s] for s in ending[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1] + out_score[i], *(behind[segments[s][1]] + in_score[s] for s in starting[i])])
    z = ahead[n]
    p_out = np.exp(ahead[:-1] + out_score + behind[1:] - z)
    p_in = np.array([math.exp(ahead[i] + in_score[s] + behind[j] - z) for s, (i, j, _) in enumerate(segments)])
    return p_out, p_in, float(z)


def sentences(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with their true spans, and look-alikes that are none: dates, prices, versions, ids."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    low = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def card() -> str:
        body = r.choice("345") + num(14)
        d = body + next(c for c in "0123456789" if luhn(body + c))
        return r.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))))

    def iban() -> str:
        body = num(18)
        check = 98 - int(body + str(int("D", 36)) + str(int("E", 36)) + "00") % 97
        s = f"DE{check:02d}{body}"
        return r.choice((s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))))

    makers: list[Callable[[], str]] = [
        lambda: f"{low(5)}.{num(2)}@{low(6)}{num(1)}.example.com",
        lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)),
        card,
        lambda: r.choice(("+1 ({0}) 555-{2}", "({0}) 555-{2}", "+49 {0} {1} {2}", "{0}-555-{2}", "+33.{0}.{1}.{2}")).format(str(r.randint(200, 999)), num(3), num(4)),
        iban,
        lambda: r.choice(("AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), f"password={num(4)}{low(3)}{num(7)}", f"token: {num(2)}{low(8)}{num(4)}")),
        lambda: f"{r.randint(100, 665):03d}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
    ]
    decoys = (lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{num(2)}", lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{num(2)}.{num(2)}", lambda: "1" + num(r.randint(1, 12)), lambda: f"{r.randint(300, 999)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(3)} {num(3)}", lambda: num(20), lambda: f"{num(4)} {num(4)}", lambda: f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)} {r.randint(10, 23)}:{num(2)}", lambda: next(x for x in iter(lambda: num(16), "") if not luhn(x)))
    for _ in range(n):
        text, spans = low(4), []
        for _ in range(r.randint(1, 3)):
            text += " " + " ".join(low(r.randint(2, 8)) for _ in range(r.randint(0, 3)))
            text = text.rstrip() + " "
            if r.random() < 0.6:
                k = r.randrange(len(makers))
                made = makers[k]()
                spans.append((k, len(text), len(text) + len(made)))
            else:
                made = r.choice(decoys)()
            text += made + r.choice(("", "", ",", "."))
        yield text + " " + low(5), spans


@lru_cache(maxsize=4)
def fitted(n_sentences: int = 240, rounds: int = 60, seed: int = 7, l2: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights (kinds x span features, outside features) by gradient ascent on the log-likelihood."""
    data = []
    for text, truth in sentences(n_sentences, seed):
        for a, b in stretches(text):
            tokens, segments = lattice(text, a, b)
            gold = {(k, s, e) for k, s, e in truth}
            chosen = np.array([float((k, tokens[i][0], tokens[j - 1][1]) in gold) for i, j, k in segments])
            outside = np.ones(len(tokens))
            for s in np.flatnonzero(chosen):
                outside[segments[s][0] : segments[s][1]] = 0.0
            data.append((tokens, segments, np.array([k for _, _, k in segments], int), *potentials(text, tokens, segments), chosen, outside))
    w_in, w_out = np.zeros((len(KINDS), N_SPAN)), np.zeros(N_OUT)
    g_in, g_out = np.full_like(w_in, 1e-8), np.full_like(w_out, 1e-8)
    for _ in range(rounds):
        d_in, d_out = -l2 * w_in, -l2 * w_out
        for tokens, segments, kinds, outside, inside, chosen, free in data:
            p_out, p_in, _ = marginals(len(tokens), segments, outside @ w_out, np.einsum("nf,nf->n", inside, w_in[kinds]))
            np.add.at(d_in, kinds, (chosen - p_in)[:, None] * inside / len(data) * 10)
            d_out = d_out + (free - p_out) @ outside / len(data) * 10
        g_in, g_out = g_in + d_in**2, g_out + d_out**2
        w_in, w_out = w_in + 0.5 * d_in / np.sqrt(g_in), w_out + 0.5 * d_out / np.sqrt(g_out)
    return w_in, w_out


def field_spans(text: str, weights: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int]]:
    w_in, w_out = weights
    for a, b in stretches(text):
        tokens, segments = lattice(text, a, b)
        if segments:
            outside, inside = potentials(text, tokens, segments)
            scores = np.einsum("nf,nf->n", inside, w_in[[k for _, _, k in segments]])
            for s in best_segments(len(tokens), segments, (outside @ w_out).tolist(), scores.tolist()):
                i, j, k = segments[s]
                if valid(KINDS[k], text[tokens[i][0] : tokens[j - 1][1]]):
                    yield k, tokens[i][0], tokens[j - 1][1]


def all_spans(text: str, weights: tuple[np.ndarray, np.ndarray]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base with the field's, both by kind and start."""
    if not MARK.search(text):
        return [], []
    base = sorted(base_spans(text))
    own = [s for s in field_spans(text, weights) if not any(s[1] < e and a < s[2] for _, a, e in base)]
    return base, sorted(base + own)


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or group of overlapping ones, replaced by its first kind in brackets."""
    parts, end, at = [], 0, 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        end = max(end, b)
        at = end
    return "".join([*parts, text[at:]])


def find_pii(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: key, counts of base spans, the base spans' digest, and all spans as text.

    Null and empty texts have no spans; repeated rows give repeated results, null keys pass, an empty df gives no
    rows; other columns are not carried. Texts are read whole.
    Offsets are code points, ends exclusive.
    """
    weights = fitted()

    def make():
        def f(keys, texts):
            rows = []
            for t in texts:
                base, spans = all_spans(t or "", weights)
                counts = [sum(k == n for k, _, _ in base) for n in range(len(BASE_KINDS))]
                rows.append((*counts, hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
            return [keys, *map(list, zip(*rows, strict=True))]

        return f

    kind = dict(df.dtypes)[key]
    return map_rows(df, [key, text], f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)


def redact(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with every span in the text replaced by its kind in brackets; `length`, if a column, follows.

    Null texts stay null; all rows and all other columns stay, whatever their names.
    """
    weights, schema, names = fitted(), df.schema, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for part in slices(batch):
                texts, columns = part.column(at).to_pylist(), list(part.columns)
                new = [t if t is None else redacted(t, all_spans(t, weights)[1]) for t in texts]
                columns[at] = pa.array(new, columns[at].type)
                if length in names:
                    n = names.index(length)
                    sizes = [old if t is None or t == u else len(u) for t, u, old in zip(texts, new, columns[n].to_pylist(), strict=True)]
                    columns[n] = pa.array(sizes, columns[n].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, schema)
