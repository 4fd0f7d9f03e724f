"""Personal data and secrets found by a character-level bidirectional LSTM with CRF transitions.

The network is small and made for numpy: characters are folded (digits alike, letters lower), gates and outputs use
piecewise-linear activations, states lie feature-major so each time step is one matrix product over all windows.
Training draws labelled spans from a generator (``example``): invented carrier text with e-mail addresses, phone
numbers, IP addresses, card numbers, national ids and secrets in many formats, and look-alikes without a label
(versions, dates, prices, plain numbers, handles, URLs). It needs no corpus, and is repeatable.

Whole texts are scored: windows of ``WINDOW`` characters overlap by twice ``MARGIN``; each window is decoded by itself,
then spans are reconciled over the document: of overlapping spans the one farther from its window's edges stands, so a
span cut by an edge gives way to the neighbour's whole one. Viterbi runs only on stretches that a best path can label
(``may_leave``); that is exact.

Defined results: null and empty texts have no spans; a row per span with the id of its document as it is, null ids and
repeated rows included; offsets count code points; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import inspect
import random
import string
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.mixing import slices
from lamina.runtime import shared_dir, table
from lamina.store import Store

KINDS = ("email", "phone", "ip", "card", "national_id", "secret")
LABELS, EMBED, HIDDEN = len(KINDS) + 1, 8, 12
WINDOW, MARGIN, SLICE = 1024, 96, 1 << 20
SYMBOLS = 131
#: Size of the training set, its window, steps and batch.
EXAMPLES, LENGTH, STEPS, GROUP = 12000, 112, 1200, 96


def folded(codes: np.ndarray) -> np.ndarray:
    """Symbol of each code point: ASCII with digits alike and letters lower; 128 other letters, 129 the rest, 130 pads."""
    base = np.arange(128, dtype=np.uint8)
    base[48:58] = 48
    base[65:91] += 32
    out = np.full(len(codes), 128, np.uint8)
    low = codes < 128
    out[low] = base[codes[low]]
    out[(codes >= 0x2000) & (codes < 0x2070)] = 129
    return out


def _word(r: random.Random) -> str:
    parts = ["the", "an", "er", "on", "re", "ti", "sch", "ung", "eau", "que", "ció", "men", "lo", "ka", "mi", "ro", "st", "ve", "ß", "é", "ou", "ing", "ble", "de", "la", "of", "th", "sh", "wh", "nd", "nt", "ly", "ed", "tion", "ha", "x", "qu", "ñ", "pf", "bad", "face", "dead", "fee", "cafe"]
    if r.random() < 0.35:  # any letters, so no spelling looks odd
        w = "".join(r.choice("abcdefghijklmnopqrstuvwxyzjkvwxzqäöüßéèñç") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 11])))
    else:
        w = "".join(r.choice(parts) for _ in range(r.choice([1, 1, 2, 2, 3, 4, 6])))
    return w.upper() if r.random() < 0.08 else w.capitalize() if r.random() < 0.12 else w


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice(string.digits) for _ in range(n))


def _pii(r: random.Random) -> tuple[str, str, str, int]:
    """Text before, the span, text after, label."""
    kind = r.randrange(1, LABELS)
    d = lambda n: _digits(r, n)
    if kind == 1:
        name = lambda: "".join(r.choice(string.ascii_lowercase) for _ in range(r.choice([2, 4, 6, 8, 11, 15, 20])))
        local = r.choice([name(), f"{name()}.{name()}", f"{name()}.{d(2)}", f"{name()}_{d(r.randint(1, 4))}", f"{name()}{d(2)}", f"{name()}-{name()}", f"{name()}+{name()}", name().capitalize()])
        return "", f"{local}@{r.choice([name(), f'mail{d(1)}.{name()}', f'{name()}.{name()}', 'mail' + d(1) + '.example'])}.{r.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io', 'edu'])}", "", kind
    if kind == 2:
        return "", r.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(11)}"]), "", kind
    if kind == 3:
        return "", ".".join(str(r.randint(0, 255)) for _ in range(4)), r.choice(["", "", "", f":{d(4)}"]), kind
    if kind == 4:
        return "", r.choice([d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", d(15), f"{d(4)} {d(6)} {d(5)}"]), "", kind
    if kind == 5:
        return "", r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", r.choice(["DE", "FR", "ES"]) + d(2) + " " + " ".join(d(4) for _ in range(4)) + " " + d(2), r.choice(["DE", "FR", "ES"]) + d(20)]), "", kind
    made = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    value = r.choice([made("0123456789abcdef", 40), made("0123456789abcdef", r.choice([32, 40, 64])), made(string.ascii_letters + string.digits, r.randint(20, 44)), "sk_live_" + made(string.ascii_letters + string.digits, 24), "AKIA" + made(string.ascii_uppercase + string.digits, 16), "ghp_" + made(string.ascii_letters + string.digits, 36)])
    value = "".join(c if r.random() > 0.12 else r.choice(string.digits) for c in value[:-3]) + d(1) + value[-2:]  # never letters alone
    before, after = r.choice([('token = "', '"'), ('token = "', '"'), ("api_key=", ""), ('secret: "', '"'), ("password: ", ""), ("key = '", "'"), ("", "")])
    return before, value, after, kind


def _decoy(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice([f"Version {d(1)}.{d(1)}", f"version {d(1)}.", f"{d(1)}.{d(2)}.{d(1)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}:{d(2)}", f"${d(1)},{d(3)}.{d(2)}", f"{d(2)}%", d(r.randint(1, 9)), d(4), f"@{_word(r).lower()}", f"http://www.{_word(r).lower()}.com/{d(3)}", f"{d(3)}.{d(2)}", f"({d(2)})", f"no. {d(3)}", "a = b", f"{_word(r)}-{_word(r)}", f"{d(4)}-{d(4)}", "x_y_z", f"{_word(r)}.{_word(r)}", '"' + _word(r) + '"'])


def example(r: random.Random, length: int = LENGTH) -> tuple[str, list[tuple[int, int, int]]]:
    """A text and its spans (start, end, label)."""
    text, spans = "", []
    marks = r.choice([None, None, None, None, ["***", "$$$", "###", "%%%", "&&&"], ["!!"], [" |"]])
    sep = r.choice([" ", " ", " ", " ", "\n", ", ", " | "])
    loud = marks == ["!!"] and r.random() < 0.5
    share = r.choice([0, 0.05, 0.2])
    if r.random() < 0.3:
        text = _word(r)[1:]  # a window may begin anywhere
    while len(text) < length + 8:
        x = r.random()
        if x < share:
            before, value, after, kind = _pii(r)
            start = len(text) + len(before)
            spans.append((start, start + len(value), kind))
            piece = before + value + after
        elif x < share + 0.1:
            piece = _decoy(r)
        else:
            piece = _word(r) + r.choice(["", "", "", "", "", ".", ","])
            piece = piece.upper() if loud else piece
        text += piece + (r.choice(marks) if marks and r.random() < 0.8 else r.choice(["", "", "", "", ".", ","]) if x < share else "") + (r.choice([" ", "\n"]) if r.random() < 0.06 else sep if r.random() < 0.5 else " ")
    cut = r.randint(0, 8)
    return text[cut : cut + length], [(max(0, s - cut), min(length, e - cut), k) for s, e, k in spans if e - cut > 0 and s - cut < length]


def init(seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (EMBED, SYMBOLS)), "trans": np.zeros((LABELS, LABELS)), "first": np.zeros(LABELS), "bias": np.zeros(LABELS)}
    for side in "fb":
        w = rng.normal(0, 1 / np.sqrt(EMBED + HIDDEN), (4 * HIDDEN, EMBED + HIDDEN + 1))
        w[:, -1] = 0
        w[HIDDEN : 2 * HIDDEN, -1] = 1.5  # remember at first
        p["lstm_" + side] = w
        p["out_" + side] = rng.normal(0, 0.3, (LABELS, HIDDEN))
    p["bias"][0] = 1
    return {k: v.astype(np.float32) for k, v in p.items()}


def gates(z: np.ndarray) -> None:
    """In place: input, forget, output gates to [0, 1], candidate to [-1, 1]."""
    s = z[: 3 * HIDDEN]
    s *= 0.25
    s += 0.5
    np.clip(s, 0, 1, out=s)
    np.clip(z[3 * HIDDEN :], -1, 1, out=z[3 * HIDDEN :])


def emissions(p: dict[str, np.ndarray], symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, LABELS, B) scores, and (T, B) of the best other label over the first; columns in order of falling size."""
    steps, n = symbols.shape
    out, over = np.empty((steps, LABELS, n), np.float32), np.zeros((steps, n), np.float32)
    live = np.searchsorted(-sizes, -np.arange(steps), side="left")  # columns with size > t
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        w, o = p["lstm_" + side], p["out_" + side]
        x = np.zeros((EMBED + HIDDEN + 1, n), np.float32)
        x[-1] = 1
        c, z, h = np.zeros((HIDDEN, n), np.float32), np.empty((4 * HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32)
        for t in order:
            m = live[t]
            if not m:
                continue
            xs, zs, cs, hs = x[:, :m], z[:, :m], c[:, :m], h[:, :m]
            xs[:EMBED] = p["embed"].take(symbols[t, :m], 1)
            np.matmul(w, xs, out=zs)
            gates(zs)
            cs *= zs[HIDDEN : 2 * HIDDEN]
            zs[3 * HIDDEN :] *= zs[:HIDDEN]
            cs += zs[3 * HIDDEN :]
            np.clip(cs, -1, 1, out=hs)
            hs *= zs[2 * HIDDEN : 3 * HIDDEN]
            xs[EMBED:-1] = hs
            if side == "f":
                np.matmul(o, hs, out=out[t, :, :m])
                out[t, :, :m] += p["bias"][:, None]
            else:
                em = out[t, :, :m]
                em += o @ hs
                np.max(em[1:], axis=0, out=over[t, :m])
                over[t, :m] -= em[0]
    return out, over


def _gradients(p: dict[str, np.ndarray], symbols: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """CRF loss per character and its gradient; symbols and gold (T, B), all of one length.

    Both directions go side by side, the backward one over reversed characters; inputs are projected for all steps at once.
    """
    steps, n = symbols.shape
    kind = p["embed"].dtype
    w = np.stack([p["lstm_f"], p["lstm_b"]])
    wx, wh, o = w[:, :, :EMBED], np.ascontiguousarray(w[:, :, EMBED:-1]), np.stack([p["out_f"], p["out_b"]])
    emb = p["embed"][:, symbols].transpose(1, 0, 2)  # (T, EMBED, B)
    emb = np.stack([emb, emb[::-1]], 1)  # (T, 2, EMBED, B)
    each = np.matmul(wx, p["embed"]) + w[:, :, -1:]  # every symbol's share of the gates
    zs = np.stack([each[0].take(symbols, 1), each[1].take(symbols[::-1], 1)]).transpose(2, 0, 1, 3).copy()
    cs, hs = np.zeros((steps + 1, 2, HIDDEN, n), kind), np.zeros((steps + 1, 2, HIDDEN, n), kind)
    act = np.empty((steps, 2, HIDDEN, n), kind)
    for t in range(steps):
        z = zs[t]
        if t:
            z += np.matmul(wh, hs[t])
        s = z[:, : 3 * HIDDEN]
        s *= 0.25
        s += 0.5
        np.clip(s, 0, 1, out=s)
        a = z[:, 3 * HIDDEN :]
        np.clip(a, -1, 1, out=a)
        c = cs[t + 1]
        np.multiply(cs[t], z[:, HIDDEN : 2 * HIDDEN], out=c)
        c += z[:, :HIDDEN] * a
        np.clip(c, -1, 1, out=act[t])
        np.multiply(act[t], z[:, 2 * HIDDEN : 3 * HIDDEN], out=hs[t + 1])
    each = np.matmul(o, hs[1:])  # (T, 2, LABELS, B)
    em = each[:, 0] + each[::-1, 1] + p["bias"][:, None]
    # forward and backward sums of the chain, in numbers scaled to one at each step
    tr = np.exp(p["trans"])
    peak = em.max(1, keepdims=True)
    e = np.exp(em - peak)
    alpha, beta, scale_t = np.empty_like(em), np.ones_like(em), np.empty((steps, 1, n), kind)
    x = e[0] * np.exp(p["first"])[:, None]
    for t in range(steps):
        if t:
            x = e[t] * (tr.T @ alpha[t - 1])
        scale_t[t] = x.sum(0)
        np.divide(x, scale_t[t], out=alpha[t])
    for t in range(steps - 2, -1, -1):
        beta[t] = tr @ (e[t + 1] * beta[t + 1])
        beta[t] /= scale_t[t + 1]
    z = (np.log(scale_t) + peak).sum((0, 1))
    g: dict[str, np.ndarray] = {}
    dem = alpha * beta
    tt, bb = np.meshgrid(np.arange(steps), np.arange(n), indexing="ij")
    dem[tt, gold, bb] -= 1
    scale = 1 / (steps * n)
    g["first"] = dem[0].sum(1) * scale
    right = e[1:] * beta[1:] / scale_t[1:]
    both = tr * np.tensordot(alpha[:-1], right, axes=((0, 2), (0, 2)))
    np.subtract.at(both, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    g["trans"] = (both * scale).astype(kind)
    score = em[tt, gold, bb].sum(0) + p["first"][gold[0]] + p["trans"][gold[:-1], gold[1:]].sum(0)
    loss = float((z - score).sum() * scale)
    dem *= scale
    g["bias"] = dem.sum((0, 2))
    dem = np.stack([dem, dem[::-1]], 1)  # (T, 2, LABELS, B)
    dout = np.matmul(dem, hs[1:].transpose(0, 1, 3, 2)).sum(0)
    dhs = np.matmul(o.transpose(0, 2, 1), dem)  # (T, 2, HIDDEN, B)
    whT, dzs = np.ascontiguousarray(wh.transpose(0, 2, 1)), np.empty_like(zs)
    open_s, open_a, open_c = (zs[:, :, : 3 * HIDDEN] > 0) & (zs[:, :, : 3 * HIDDEN] < 1), np.abs(zs[:, :, 3 * HIDDEN :]) < 1, np.abs(cs[1:]) < 1
    dh, dc = np.zeros((2, HIDDEN, n), kind), np.zeros((2, HIDDEN, n), kind)
    for t in range(steps - 1, -1, -1):
        zt, dz, d = zs[t], dzs[t], dhs[t]
        d += dh
        dc += d * zt[:, 2 * HIDDEN : 3 * HIDDEN] * open_c[t]
        np.multiply(dc, zt[:, 3 * HIDDEN :], out=dz[:, :HIDDEN])
        np.multiply(dc, cs[t], out=dz[:, HIDDEN : 2 * HIDDEN])
        np.multiply(d, act[t], out=dz[:, 2 * HIDDEN : 3 * HIDDEN])
        np.multiply(dc, zt[:, :HIDDEN], out=dz[:, 3 * HIDDEN :])
        s = dz[:, : 3 * HIDDEN]
        s *= 0.25
        s *= open_s[t]
        dz[:, 3 * HIDDEN :] *= open_a[t]
        dh = np.matmul(whT, dz)
        dc *= zt[:, HIDDEN : 2 * HIDDEN]
    dw = np.concatenate([np.matmul(dzs, emb.transpose(0, 1, 3, 2)).sum(0), np.matmul(dzs, hs[:-1].transpose(0, 1, 3, 2)).sum(0), dzs.sum((0, 3))[:, :, None]], 2)
    demb = np.matmul(wx.transpose(0, 2, 1), dzs)
    demb = demb[:, 0] + demb[::-1, 1]  # (T, EMBED, B)
    for i, side in enumerate("fb"):
        g["lstm_" + side], g["out_" + side] = dw[i], dout[i]
    flat = symbols.ravel()
    g["embed"] = np.stack([np.bincount(flat, demb[:, i].ravel(), SYMBOLS) for i in range(EMBED)])
    return loss, g


_trained: dict[tuple, dict[str, np.ndarray]] = {}


def labelled(n: int, seed: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    r = random.Random(seed)
    symbols, gold = np.empty((length, n), np.int64), np.zeros((length, n), np.int64)
    for j in range(n):
        text, spans = example(r, length)
        symbols[:, j] = folded(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        for s, e, k in spans:
            gold[s:e, j] = k
    return symbols, gold


def train(examples: int = EXAMPLES, steps: int = STEPS, seed: int = 11) -> dict[str, np.ndarray]:
    """The trained network; made once per process and setting."""
    key = (examples, steps, seed)
    if key in _trained:
        return _trained[key]
    p, (symbols, gold) = init(), labelled(examples, seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    rng = np.random.default_rng(seed)
    for i in range(1, steps + 1):
        pick = rng.integers(0, examples, GROUP)
        _, g = _gradients(p, symbols[:, pick], gold[:, pick])
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        rate = 0.015 * min(1, i / 20) * (1 - i / (steps + 1)) ** 0.7
        for k in p:
            x = g[k] * min(1, 0.5 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x**2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
    _trained[key] = p
    return p


def _viterbi(p: dict[str, np.ndarray], em: np.ndarray, sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best labels (T, B) of stretches; start: (LABELS, B) scores to begin with. Each ends before an O, if not at its window's end."""
    steps, _, n = em.shape
    back = np.zeros((steps, LABELS, n), np.int8)
    score = start + em[0]
    final = np.zeros((LABELS, n), np.float32)
    for t in range(1, steps + 1):
        done = sizes == t
        final[:, done] = score[:, done]
        if t == steps:
            break
        step = score[:, None] + p["trans"][:, :, None]
        back[t] = step.argmax(0)
        score = step.max(0) + em[t]
    return final, back


def may_leave(p: dict[str, np.ndarray], d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(T, B) positions that the best path may label. d: best other emission minus that of "nothing".

    In a best path each excursion from "nothing" scores no less than staying. Bounding all transitions of an excursion
    by their greatest, its score is a difference of prefix sums, so the best excursion around each position comes from
    running minima and maxima. No position outside can be labelled.
    """
    steps, n = d.shape
    tr, first = p["trans"].astype(np.float64), p["first"].astype(np.float64)
    enter, stay, leave = (tr[0, 1:] - tr[0, 0]).max(), (tr[1:, 1:] - tr[0, 0]).max(), (tr[1:, 0] - tr[0, 0]).max()
    total = np.zeros((steps + 1, n))
    np.cumsum(d + stay, axis=0, out=total[1:])
    low = total[:-1] - enter
    low[0] = total[0] - (first[1:] - first[0]).max()
    np.minimum.accumulate(low, axis=0, out=low)
    high = total[1:] + leave
    high[sizes - 1, np.arange(n)] -= leave + min(0.0, -leave)
    high[np.arange(steps)[:, None] >= sizes] = -np.inf
    high = np.maximum.accumulate(high[::-1], axis=0)[::-1]
    return high - low - stay >= -1e-3


def decode(p: dict[str, np.ndarray], em: np.ndarray, d: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Spans (window, start, end, label) of the best label sequence of each window."""
    steps, _, n = em.shape
    tr = p["trans"]
    hot = may_leave(p, d, sizes).T
    padded = np.zeros((n, steps + 2), np.int8)
    padded[:, 1:-1] = hot
    edges = np.diff(padded, axis=1)
    window, begin = np.nonzero(edges == 1)
    _, end = np.nonzero(edges == -1)
    if not len(window):
        return []
    spans = []
    lengths = end - begin
    order = np.argsort(lengths, kind="stable")
    for part in np.array_split(order, max(1, len(order) // 2048)):
        w, b, size = window[part], begin[part], lengths[part]
        longest = int(size.max())
        at = np.minimum(b[None] + np.arange(longest)[:, None], steps - 1)
        piece = em[at[:, None, :], np.arange(LABELS)[None, :, None], w[None, None, :]]
        start = np.where(b[None] == 0, p["first"][:, None], tr[0][:, None])
        final, back = _viterbi(p, piece, size, start)
        open_end = b + size < sizes[w]
        final = final + np.where(open_end, tr[:, :1], 0)
        label = final.argmax(0)
        path = np.zeros((longest, len(w)), np.int8)
        cols = np.arange(len(w))
        for t in range(longest - 1, -1, -1):
            on = size > t
            path[t, on] = label[on]
            if t:
                label = np.where(on, back[t][label, cols], label)
        for j in np.flatnonzero(path.any(0)):
            k = path[: size[j], j]
            cuts = np.flatnonzero(np.diff(np.concatenate([[0], k, [0]])))
            for s, e in zip(cuts, cuts[1:]):
                if k[s]:
                    spans.append((int(w[j]), int(b[j] + s), int(b[j] + e), int(k[s])))
    return spans


def find(p: dict[str, np.ndarray], texts: list[str], window: int = WINDOW, margin: int = MARGIN) -> list[tuple[int, int, int, int]]:
    """Spans (text, start, end, label) of texts, in order."""
    codes = folded(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    stride, cuts = window - 2 * margin, []
    for i in range(len(texts)):
        size, at = int(bounds[i + 1] - bounds[i]), 0
        while size:
            cuts.append((min(window, size - at), i, at))
            if at + window >= size:
                break
            at += stride
    if not cuts:
        return []
    cuts.sort(reverse=True)
    found: dict[int, list] = {}
    group = max(1, 4_000_000 // window)
    for g in range(0, len(cuts), group):
        part = cuts[g : g + group]
        sizes = np.array([c[0] for c in part])
        steps = int(sizes[0])
        base = np.array([bounds[i] + at for _, i, at in part])
        where = np.minimum(base[None] + np.arange(steps)[:, None], len(codes) - 1)
        em, over = emissions(p, codes[where], sizes)
        for w, s, e, k in decode(p, em, over, sizes):
            size, i, at = part[w]
            whole = int(bounds[i + 1] - bounds[i])
            room = min(s if at else whole, size - e if at + size < whole else whole)
            found.setdefault(i, []).append((-room, at + s, at + e, k))
    return [(i, s, e, k) for i in sorted(found) for s, e, k in reconciled(found[i])]


def reconciled(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, label) in order: of overlapping (-room, start, end, label) the first in order of these stands.

    Spans that stand don't overlap, so each new one is held against its two neighbours among them only.
    """
    starts: list[int] = []
    taken: dict[int, tuple[int, int]] = {}
    for _, s, e, k in sorted(spans):
        at = bisect.bisect_left(starts, s)
        before = at == 0 or taken[starts[at - 1]][0] <= s
        if before and (at == len(starts) or e <= starts[at]):
            starts.insert(at, s)
            taken[s] = (e, k)
    return [(s, *taken[s]) for s in starts]


def trained(spark: SparkSession) -> dict[str, np.ndarray]:
    """The network, trained once and kept in the shared folder under a hash of this module, so that sessions which share
    the folder train once. Training takes one core of the driver about half a minute, whatever the corpus."""
    store = Store(spark, shared_dir(spark))
    name = f"pii-{hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:16]}.json"
    if store.exists("lamina-models", name):
        return {k: np.array(v, np.float32) for k, v in store.read("lamina-models", name).items()}
    p = train()
    store.write({k: v.astype(float).tolist() for k, v in p.items()}, "lamina-models", name)
    return p


def spans(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, start, end, kind, value) of every span found."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained(docs.sparkSession))

    def run(batches):
        for b in batches:
            for start, length in slices(b.column(1), SLICE):
                part = b.slice(start, length)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                rows = [(ids[i], s, e, KINDS[k - 1], texts[i][s:e]) for i, s, e, k in find(shared.value, texts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "start", "end", "kind", "value"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, end long, kind string, value string")


def op4_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii_spans": op4_pii_spans}
ORACLES: dict[str, str] = {}
