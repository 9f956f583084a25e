"""Personal data spans: fixed patterns plus a character BiLSTM with CRF transitions.

The patterns (email, ip, card, phone) are searched in every whole text and always
stay.  The tagger is trained in numpy from labelled spans: written personal data of
known kind and place, in contexts cut from a bounded sample of the corpus, next to
distractors (dates, versions, keys, prices).  It reads overlapping windows; every
window is decoded by Viterbi, spans cut by a window's edge are left to the window
that holds them whole, and the spans of all windows of a text are reconciled at once
by the non-overlapping selection of greatest weight.  A tagged span is added when it
touches no pattern span and passes its kind's check.

Every kind needs a digit, an ``@`` or a bracketed "at".  Decoding a window without one
is constrained to "outside", so such windows are not evaluated; this skips no span.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, map_text

KINDS = ("email", "ip", "card", "phone")
FIT_DOCS = 300          # documents contexts are cut from (expected; at most twice that)
FIT_WINDOWS, EPOCHS, BATCH, RATE = 1600, 5, 40, 0.02
WINDOW, STRIDE = 96, 48
HIDDEN = 16
FIT_LENGTH = 56

# --- fixed patterns -------------------------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(]\s?at\s?[\])]", re.IGNORECASE)


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _byte_sized(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str):
    """Leftmost non-overlapping emails, found from each ``@`` (linear in the text)."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        else:
            end = at + 1    # no address holds this sign, so none that comes later reaches over it
        at = text.find("@", max(end, at + 1))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all pattern spans, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte_sized, m[0].split(".")))]
    for m in _CARD.finditer(text):
        number = digits(m[0])
        if 14 <= len(number) <= 19 and luhn(number):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


# --- checks of tagged spans -----------------------------------------------------------------------

_SPOKEN = re.compile(r"[a-z0-9._%+-]+\s?(?:@|[\[(]\s?at\s?[\])])\s?[a-z0-9-]+(?:\s?(?:\.|[\[(]\s?dot\s?[\])])\s?[a-z0-9-]+)+",
                     re.IGNORECASE)
_BROKEN_IP = re.compile(r"([0-9]{1,3})(?:\.|\[\.\]|\(\.\))([0-9]{1,3})(?:\.|\[\.\]|\(\.\))([0-9]{1,3})"
                        r"(?:\.|\[\.\]|\(\.\))([0-9]{1,3})")
_DOTTED_CARD = re.compile(r"[0-9]{4}(?:[ ./-][0-9]{3,6}){2,4}")
_LOCAL_PHONE = re.compile(r"\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}(?:[ ./-][0-9]{2,4}){1,3}")


def valid(kind: int, s: str) -> bool:
    """Whether a tagged string can be personal data of its kind."""
    if kind == 0:
        return bool(_SPOKEN.fullmatch(s))
    if kind == 1:
        m = _BROKEN_IP.fullmatch(s)
        return bool(m) and all(map(_byte_sized, m.groups()))
    number = digits(s)
    if kind == 2:
        return bool(_DOTTED_CARD.fullmatch(s)) and 14 <= len(number) <= 19 and luhn(number)
    return bool(_LOCAL_PHONE.fullmatch(s)) and 10 <= len(number) <= 12


# --- the tagger -----------------------------------------------------------------------------------

_MARKS = " \n@.+-()[]_%:/=\"',;|#&*<>{}$!?"     # fixed symbols; letters and the digit class follow
N_SYMBOL = 2 + len(_MARKS) + 26 + 1             # 0: padding, 1: any other character
_SYMBOL = np.ones(256, np.int64)
for _i, _c in enumerate(_MARKS):
    _SYMBOL[ord(_c)] = 2 + _i
for _i in range(26):
    _SYMBOL[[97 + _i, 65 + _i]] = 2 + len(_MARKS) + _i
_SYMBOL[48:58] = N_SYMBOL - 1
N_TAG = 1 + 2 * len(KINDS)                      # outside; then begin and inside of each kind
_FORBIDDEN = np.zeros((N_TAG, N_TAG))
_FORBIDDEN_START = np.zeros(N_TAG)
for _k in range(len(KINDS)):
    _FORBIDDEN[[t for t in range(N_TAG) if t not in (2 * _k + 1, 2 * _k + 2)], 2 * _k + 2] = -1e4
    _FORBIDDEN_START[2 * _k + 2] = -1e4


def symbols(texts: list[str], length: int) -> np.ndarray:
    out = np.zeros((len(texts), length), np.int64)
    for i, t in enumerate(texts):
        code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[i, :len(code)] = _SYMBOL[np.minimum(code, 255)] * (code < 128) + (code >= 128)
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _logsumexp(x, axis):
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


class BiLstmCrf:
    """Bidirectional LSTM over symbols, linear emissions, first-order tag transitions."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 0.3, (N_SYMBOL, 4 * h))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.p["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.p["o"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, N_TAG))
        self.p["e"] = np.zeros(N_TAG)
        self.p["t"] = np.zeros((N_TAG, N_TAG))
        self.p["s"] = np.zeros(N_TAG)

    def _run(self, sym: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        n, length = sym.shape
        h = self.hidden
        state, cell, out = np.zeros((n, h)), np.zeros((n, h)), np.zeros((length, n, h))
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            gate = self.p["x" + d][sym[:, t]] + state @ self.p["h" + d] + self.p["c" + d]
            i, f, o = _sigmoid(gate[:, :h]), _sigmoid(gate[:, h:2 * h]), _sigmoid(gate[:, 2 * h:3 * h])
            g = np.tanh(gate[:, 3 * h:])
            old, prev = cell, state
            cell = f * old + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            if tape is not None:
                tape.append((t, i, f, o, g, old, prev, squashed))
        return out

    def emissions(self, sym: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(sym, "f"), self._run(sym, "b")], 2) @ self.p["o"] + self.p["e"]

    def _transitions(self):
        return self.p["t"] + _FORBIDDEN, self.p["s"] + _FORBIDDEN_START

    def gradients(self, sym: np.ndarray, tag: np.ndarray) -> tuple[float, dict]:
        n, length = sym.shape
        h, grad = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        tapes = {"f": [], "b": []}
        hidden = np.concatenate([self._run(sym, d, tapes[d]) for d in "fb"], 2)
        emit = hidden @ self.p["o"] + self.p["e"]
        trans, start = self._transitions()
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[0] = start + emit[0]
        for t in range(1, length):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + emit[t]
        for t in range(length - 2, -1, -1):
            beta[t] = _logsumexp(trans + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[-1], 1)
        d_emit = np.exp(alpha + beta - total[:, None])
        rows = np.arange(n)
        gold = start[tag[:, 0]] + emit[0][rows, tag[:, 0]]
        grad["s"] += d_emit[0].sum(0) - np.bincount(tag[:, 0], minlength=N_TAG)
        for t in range(1, length):
            pair = alpha[t - 1][:, :, None] + trans + (emit[t] + beta[t])[:, None, :] - total[:, None, None]
            grad["t"] += np.exp(pair).sum(0)
            np.add.at(grad["t"], (tag[:, t - 1], tag[:, t]), -1.0)
            gold = gold + trans[tag[:, t - 1], tag[:, t]] + emit[t][rows, tag[:, t]]
        d_emit[np.arange(length)[:, None], rows[None, :], tag.T] -= 1.0
        grad["o"] = np.einsum("tnh,tnk->hk", hidden, d_emit)
        grad["e"] = d_emit.sum((0, 1))
        d_hidden = d_emit @ self.p["o"].T
        for d, part in (("f", d_hidden[:, :, :h]), ("b", d_hidden[:, :, h:])):
            d_state, d_cell = np.zeros((n, h)), np.zeros((n, h))
            for t, i, f, o, g, old, prev, squashed in reversed(tapes[d]):
                d_state = d_state + part[t]
                d_cell = d_cell + d_state * o * (1 - squashed ** 2)
                d_gate = np.concatenate([d_cell * g * i * (1 - i), d_cell * old * f * (1 - f),
                                         d_state * squashed * o * (1 - o), d_cell * i * (1 - g ** 2)], 1)
                np.add.at(grad["x" + d], sym[:, t], d_gate)
                grad["h" + d] += prev.T @ d_gate
                grad["c" + d] += d_gate.sum(0)
                d_state, d_cell = d_gate @ self.p["h" + d].T, d_cell * f
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    def fit(self, sym: np.ndarray, tag: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            loss = []
            order = rng.permutation(len(sym))
            for a in range(0, len(order), BATCH):
                at = order[a:a + BATCH]
                value, grad = self.gradients(sym[at], tag[at])
                loss.append(value)
                step += 1
                norm = np.sqrt(sum((g ** 2).sum() for g in grad.values()))
                rate = RATE / (1 + epoch)
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
            losses.append(float(np.mean(loss)))
        return losses

    def decode(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best tag of every position, its emission minus that of "outside")."""
        emit = self.emissions(sym)
        trans, start = self._transitions()
        length, n, _ = emit.shape
        back = np.zeros((length, n, N_TAG), np.int64)
        score = start + emit[0]
        for t in range(1, length):
            step = score[:, :, None] + trans
            back[t] = step.argmax(1)
            score = step.max(1) + emit[t]
        tag = np.zeros((n, length), np.int64)
        tag[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            tag[:, t - 1] = back[t][np.arange(n), tag[:, t]]
        gain = np.take_along_axis(emit, tag.T[:, :, None], 2)[:, :, 0] - emit[:, :, 0]
        return tag, gain.T


# --- labelled windows -----------------------------------------------------------------------------

_NAMES = ("anna", "ben.k", "c_lopez", "d-meyer", "eva99", "info", "j.smith+news", "office", "sales", "zoe.w")
_HOSTS = ("example", "mail", "post-box", "uni", "corp7", "web.host", "my-site")
_ENDS = ("com", "org", "net", "de", "fr", "es", "io", "co.uk")


def _card_number(rng, size: int) -> str:
    body = "".join(map(str, rng.integers(0, 10, size - 1)))
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


def _grouped(rng, number: str, sep: str) -> str:
    return sep.join(number[i:i + 4] for i in range(0, len(number), 4))


def written_span(rng) -> tuple[int, str]:
    """A kind and a way people write personal data of that kind."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    kind = int(rng.integers(4))
    if kind == 0:
        at, dot = pick(("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."))
        return 0, f"{pick(*_NAMES)}{at}{pick(*_HOSTS)}{dot}{pick(*_ENDS)}"
    if kind == 1:
        return 1, pick(".", ".", "[.]", "(.)").join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        return 2, _grouped(rng, _card_number(rng, int(rng.integers(14, 18))), pick("", " ", "-", ".", "/"))
    area, sep = num(3), pick(" ", "-", ".")
    local = pick(f"({area}) {num(3)}{sep}{num(4)}", f"{area}{sep}{num(3)}{sep}{num(4)}", f"0{num(2)}/{num(3)}{sep}{num(4)}")
    return 3, pick(f"+{num(1)} {local}", f"+{num(2)}{sep}{area}{sep}{num(7)}", local, local)


def _distractor(rng) -> str:
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    code = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, int(rng.integers(8, 24))))
    return pick(f"password={code}", f'token = "{code}"', f"key: {code}", f"20{num(2)}-0{num(1)}-1{num(1)}",
                f"1{num(1)}:{num(2)}", f"version {num(1)}.{num(1)}.{num(1)}", f"${num(3)}.{num(2)}", num(5), num(9),
                f"CC BY-NC {num(1)}.0", f"pages {num(2)}-{num(3)}", f"@{code[:6]}", f"§ {num(1)}.{num(1)}", f"{num(3)},{num(3)}")


def labelled_windows(texts: list[str], n: int = FIT_WINDOWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of ``n`` windows: a written span or a distractor between two context cuts."""
    rng = np.random.default_rng(seed)
    pool = [c for t in texts for c in (re.sub(r"\S*[0-9@]\S*", "", t),) if len(c) > 2 * FIT_LENGTH] \
        or ["the quick brown fox jumps over the lazy dog and runs on along the river. " * 4]
    sym, tag = np.zeros((n, FIT_LENGTH), np.int64), np.zeros((n, FIT_LENGTH), np.int64)
    for r in range(n):
        source = pool[int(rng.integers(len(pool)))]
        at = int(rng.integers(len(source) - FIT_LENGTH))
        kind, middle = written_span(rng) if rng.random() < 0.7 else (-1, _distractor(rng))
        room = max(0, FIT_LENGTH - len(middle) - 2)
        lead = int(rng.integers(room + 1))
        before = source[at:at + lead].rsplit(" ", 1)[0] + " " if lead else ""
        text = (before + middle + ("" if rng.random() < 0.2 else ".") + " " + source[at + lead:])[:FIT_LENGTH]
        sym[r, :len(text)] = symbols([text], FIT_LENGTH)[0, :len(text)]
        if kind >= 0:
            a, b = len(before), min(len(before) + len(middle), FIT_LENGTH)
            tag[r, a:b], tag[r, a:a + 1] = 2 * kind + 2, 2 * kind + 1
    return sym, tag


def fit_tagger(texts: list[str]) -> BiLstmCrf:
    model = BiLstmCrf()
    model.fit(*labelled_windows(texts))
    return model


# --- whole texts ----------------------------------------------------------------------------------

def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The non-overlapping (start, kind, end) of greatest total weight; ties: the earlier set."""
    best: dict[tuple[int, int, int], float] = {}
    for a, kind, b, weight in spans:
        best[a, kind, b] = max(weight, best.get((a, kind, b), 0.0))
    order = sorted(best, key=lambda s: (s[2], s[0], s[1]))
    ends = [s[2] for s in order]
    total, chosen = [0.0], [()]
    for i, s in enumerate(order):
        j = bisect_right(ends, s[0], 0, i)
        take = total[j] + best[s]
        if take > total[i]:
            total.append(take)
            chosen.append((s, j))
        else:
            total.append(total[i])
            chosen.append((None, i))
    out, i = [], len(order)
    while i:
        s, i = chosen[i]
        if s:
            out.append(s)
    return out[::-1]


def tagged_spans(model: BiLstmCrf, texts: list[str], batch: int = 2048) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans of each text from all its overlapping windows."""
    place = []
    for i, t in enumerate(texts):
        at = {m.start() // STRIDE for m in _TRIGGER.finditer(t)}
        place += [(i, w * STRIDE) for w in sorted({w for a in at for w in (a - 1, a) if w >= 0})]
    found: list[list] = [[] for _ in texts]
    for a in range(0, len(place), batch):
        here = place[a:a + batch]
        cut = [texts[i][s:s + WINDOW] for i, s in here]
        tag, gain = model.decode(symbols(cut, WINDOW))
        for (i, s), piece, tags, gains in zip(here, cut, tag, gain, strict=True):
            if not tags.any():
                continue
            begin = np.flatnonzero((tags % 2 == 1) & (tags > 0))
            for b in begin.tolist():
                e, kind = b + 1, (int(tags[b]) - 1) // 2
                while e < len(piece) and tags[e] == 2 * kind + 2:
                    e += 1
                e = min(e, len(piece))
                while e > b and piece[e - 1] in " \n.,;:":
                    e -= 1
                cut_off = (b == 0 and s > 0) or (e == WINDOW and s + WINDOW < len(texts[i]))
                weight = float(gains[b:e].sum()) if e > b else 0.0
                if not cut_off and weight > 0 and valid(kind, piece[b:e]):
                    found[i].append((s + b, kind, s + e, weight))
    return [reconcile(f) for f in found]


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_spans(model: BiLstmCrf, texts: list) -> tuple[list[list], list[list]]:
    """(pattern spans, added spans) of each text."""
    base = [pattern_spans(t) if t and _TRIGGER.search(t) else [] for t in texts]
    busy = [i for i, t in enumerate(texts) if t and _TRIGGER.search(t)]
    added: list[list] = [[] for _ in texts]
    for i, spans in zip(busy, tagged_spans(model, [texts[i] for i in busy]), strict=True):
        edge = sorted((a, b) for a, _, b in base[i])
        added[i] = [s for s in spans if not any(a < s[2] and s[0] < b for a, b in edge)]
    return base, added


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern spans by kind), base_sha256, spans, n_added of every row.

    Offsets are code points, the end exclusive.  Null and empty texts have no span; repeated rows are
    searched one by one; other columns are ignored; an empty table gives an empty result; texts are
    searched whole.  Ties of the reconciliation go to the earlier spans."""
    n = docs.count()
    rows = (docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= 65536)
                                                 & hash_share(F.col("doc_id"), FIT_DOCS / max(n, 1)))
            .orderBy(F.xxhash64("doc_id"), "text").limit(2 * FIT_DOCS).collect())
    shared = docs.sparkSession.sparkContext.broadcast(fit_tagger([r["text"] for r in rows]))   # fixed size

    def make():
        model = shared.value

        def fn(texts):
            base, added = find_spans(model, texts)
            out = {f"n_{kind}": pa.array([sum(s[1] == k for s in b) for b in base], pa.int64())
                   for k, kind in enumerate(KINDS)}
            out["base_sha256"] = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string())
            out["spans"] = pa.array([joined(sorted(b + a)) for b, a in zip(base, added, strict=True)], pa.string())
            out["n_added"] = pa.array([len(a) for a in added], pa.int64())
            return out

        return fn

    return map_text(docs, ["doc_id"], "text", "n_email long, n_ip long, n_card long, n_phone long, "
                    "base_sha256 string, spans string, n_added long", make)
