"""Fit the block labeller: python -m docloom.llm.training.fit_boilerplate SF_DIR

Reads at most ``MAX_TEXTS`` texts of each table (the bound on labelled rows), holds out a tenth, and writes
``models/boilerplate.npz``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from ..boilerplate import MODEL, ROWS, WORDS, Labeller, blocks
from ..boilerplate import OFFSETS as AT
from .furniture_labels import labels

MAX_TEXTS = 30_000
D, H = 24, 16


def examples(sf: str, seed: int):
    rng = np.random.default_rng(seed)
    out = []
    for name in ("crawled_pages", "chunks"):
        texts = list(dict.fromkeys(t for t in pq.read_table(f"{sf}/{name}.parquet", columns=["content"]).column(0).to_pylist() if t))
        for k in rng.permutation(len(texts))[:MAX_TEXTS]:
            spans, read, context = blocks(texts[k])
            if not spans:
                continue
            y = labels(texts[k])
            out.append((read, context, np.array([float(y[a] or 0) for a, _ in spans], "float32")))
    return out


def step(w, batch, rng, drop=0.1):
    """Loss, number right and gradients of one batch of examples."""
    n = np.array([len(b[2]) for b in batch])
    order = np.argsort(-n, kind="stable")
    n = n[order]
    T, B = n[0], len(n)
    ids, seg, wt = [], [], []
    X = np.zeros((T, B, D), "float32")
    Y, M = np.zeros((T, B), "float32"), np.zeros((T, B), "float32")
    for k, j in enumerate(order):
        read, ctx, y = batch[j]
        Y[: n[k], k], M[: n[k], k] = y, 1
        for t in range(n[k]):
            words = [v for v in read[t][0] if rng.random() > drop]
            rows = [*words, *(np.array(read[t][1]) + AT[:6]), *(np.array(ctx[t]) + AT[6:])]
            ids += rows
            seg += [t * B + k] * len(rows)
            wt += [1 / max(1, len(words))] * len(words) + [1.0] * 11
    ids, seg, wt = np.array(ids), np.array(seg), np.array(wt, "float32")
    np.add.at(X.reshape(-1, D), seg, w["E"][ids] * wt[:, None])
    g = {k: np.zeros_like(v) for k, v in w.items()}
    hs, tape = {}, {}
    for s in "fb":
        h, c = np.zeros((B, H), "float32"), np.zeros((B, H), "float32")
        out = np.zeros((T, B, H), "float32")
        rec = []
        for t in range(T) if s == "f" else range(T - 1, -1, -1):
            z = X[t] @ w["W" + s] + h @ w["U" + s] + w["b" + s]
            sg = 1 / (1 + np.exp(-z[:, : 3 * H]))
            i, f, o, u = sg[:, :H], sg[:, H : 2 * H], sg[:, 2 * H :], np.tanh(z[:, 3 * H :])
            c2 = f * c + i * u
            tc = np.tanh(c2)
            m = M[t][:, None]
            rec.append((t, h, c, i, f, o, u, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        hs[s], tape[s] = out, rec
    hh = np.concatenate([hs["f"], hs["b"]], 2)
    logit = (hh @ w["V"])[:, :, 0] + (X @ w["S"])[:, :, 0] + w["c"]
    p = 1 / (1 + np.exp(-logit))
    loss = -(M * (Y * np.log(p + 1e-7) + (1 - Y) * np.log(1 - p + 1e-7))).sum()
    d = (M * (p - Y) / M.sum())[:, :, None].astype("float32")
    g["V"] += (hh * d).sum((0, 1))[:, None]
    g["S"] += (X * d).sum((0, 1))[:, None]
    g["c"] += d.sum()
    dX = d * w["S"][:, 0]
    for q, s in enumerate("fb"):
        dh, dc = np.zeros((B, H), "float32"), np.zeros((B, H), "float32")
        for t, h0, c0, i, f, o, u, tc, m in reversed(tape[s]):
            dh = dh + d[t] * w["V"][q * H : (q + 1) * H, 0]
            dhm = dh * m
            dcm = dc * m + dhm * o * (1 - tc * tc)
            dz = np.concatenate([dcm * u * i * (1 - i), dcm * c0 * f * (1 - f), dhm * tc * o * (1 - o), dcm * i * (1 - u * u)], 1)
            g["W" + s] += X[t].T @ dz
            g["U" + s] += h0.T @ dz
            g["b" + s] += dz.sum(0)
            dX[t] += dz @ w["W" + s].T
            dh, dc = dz @ w["U" + s].T + dh * (1 - m), dcm * f + dc * (1 - m)
    np.add.at(g["E"], ids, dX.reshape(-1, D)[seg] * wt[:, None])
    return loss, int((((logit > 0) == Y) * M).sum()), int(M.sum()), g


def main(sf: str, epochs: int = 6) -> None:
    rng = np.random.default_rng(1)
    data = examples(sf, 3)
    rng.shuffle(data)
    held, data = data[: len(data) // 10], data[len(data) // 10 :]
    init = lambda *s: rng.normal(0, 0.5 / np.sqrt(s[0]), s).astype("float32")
    w = {"E": rng.normal(0, 0.3, (ROWS, D)).astype("float32"), "V": init(2 * H, 1), "S": init(D, 1), "c": np.zeros(1, "float32")}
    for s in "fb":
        w |= {"W" + s: init(D, 4 * H), "U" + s: init(H, 4 * H), "b" + s: np.r_[np.zeros(H), np.ones(H), np.zeros(2 * H)].astype("float32")}
    m, v, k = {x: np.zeros_like(y) for x, y in w.items()}, {x: np.zeros_like(y) for x, y in w.items()}, 0
    began = time.time()
    for e in range(epochs):
        data.sort(key=lambda b: len(b[2]) + rng.random() * 6)
        groups = [data[a : a + 48] for a in range(0, len(data), 48)]
        rng.shuffle(groups)
        loss = right = total = 0
        for j, batch in enumerate(groups):
            l_, r_, t_, g = step(w, batch, rng)
            loss, right, total, k = loss + l_, right + r_, total + t_, k + 1
            lr = 0.006 * (1 - (e + j / len(groups)) / epochs) + 1e-4
            for x in w:
                m[x] = 0.9 * m[x] + 0.1 * g[x]
                v[x] = 0.99 * v[x] + 0.01 * g[x] ** 2
                w[x] -= lr * (m[x] / (1 - 0.9**k)) / (np.sqrt(v[x] / (1 - 0.99**k)) + 1e-8)
        net = Labeller(w)
        bad = seen = 0
        for (read, ctx, y), s in zip(held, net.scores([(b[0], b[1]) for b in held])):
            bad, seen = bad + int(((s > 0) != (y > 0)).sum()), seen + len(y)
        print(f"epoch {e}: loss {loss / total:.5f}, wrong {1 - right / total:.5f}; held out {bad} of {seen} wrong; {time.time() - began:.0f} s", flush=True)
    np.savez_compressed(Path(__file__).parent.parent / MODEL, **{x: y.astype("float16") for x, y in w.items()})


if __name__ == "__main__":
    main(sys.argv[1])
