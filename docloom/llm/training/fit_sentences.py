"""Fit the sentence tagger: python -m docloom.llm.training.fit_sentences SF_DIR

An averaged structured perceptron over at most ``MAX_TEXTS`` documents (the bound on labelled rows), a tenth
held out.  For scripts that write no sentence ends the chain is also trained on text without any: units that
layout shows to be one sentence are strung together in pseudorandom order, their marks stripped, the seams
being the boundaries.  What the documents hold too little of is made up from the rules' lists: abbreviations before
names, ordinals before months, states and their bodies, numbers and mixed-case words that begin sentences, marks of
further scripts; and a part of the texts is read once more in small letters.  Documents whose id ends in ``HELD`` are
never trained on.  Writes ``models/sentences.npz``.
"""

from __future__ import annotations

import re
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from ..sentences import BUCKETS, MARKS, MODEL, Tagger, _BARE, candidates, decode, distance, features, hashed, units
from .sentence_labels import BODIES, LEADING, MONTHS, STATES, TRAILING, label

MAX_TEXTS = 10_000
HELD = 3
N_MADE, SMALL_SHARE = 6_000, 0.15
#: first and last letters of scripts without capitals, what stands between their words, and their marks
SCRIPTS = [(0x1000, 0x1020, " ", "\u104b"), (0x1780, 0x17A2, "", "\u17d4"), (0x1780, 0x17A2, "", "\u17d5"), (0x0F40, 0x0F69, "\u0f0b", "\u0f0d"), (0x0F40, 0x0F69, "\u0f0b", "\u0f0e"), (0x1200, 0x1240, " ", "\u1362"), (0x0905, 0x0939, " ", "\u0964")]


def strung(sentences: list[str], rng, n: int) -> list[tuple[str, set[int]]]:
    """Texts of several unpunctuated sentences and the places where they end."""
    out = []
    for _ in range(n):
        text, ends = "", set()
        for k in rng.integers(0, len(sentences), rng.integers(2, 9)):
            text += (" " if rng.random() < 0.9 else "  ") * bool(text) + sentences[k].strip(MARKS + " ")
            ends.add(len(text))
        out.append((text, ends))
    return out


def made_up(rng, n: int) -> list[tuple[str, set[int]]]:
    """Texts of sentences made to hold what is rare, and the places where these end."""
    pick = lambda x: x[rng.integers(len(x))]
    syllables = [a + b for a in "b d f g k l m n p r s t v w st tr br pl".split() for b in "a e i o u an en or il us".split()]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 4)))
    name = lambda: word().capitalize()
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    latin = sorted(a for a in LEADING if a.isascii() and len(a) > 1 or a in "p z")
    trailing = sorted(a for a in TRAILING if a.isascii())
    months, states, bodies = sorted(MONTHS), sorted(STATES), sorted(BODIES)
    titles = [a for a in latin if a in "dr prof mr mrs ms mme mlle sr sra srta st fig figs sec vol no nr".split()]

    def sentence() -> str:
        k = rng.integers(0, 12)
        end = pick("....!?")
        if k < 3:
            return f"{pick([pick(titles).capitalize() + '. ' + name(), name()])} {words(1, 4)} {pick([pick(titles).capitalize(), pick(latin)])}. {pick([name(), name(), str(rng.integers(1, 90))])} {words(0, 4)}".rstrip() + end
        if k == 3:
            return f"{name()} {words(0, 3)} {rng.integers(1, 32)}. {pick(months).capitalize()} {words(1, 5)}{end}"
        if k == 4 and rng.random() < 0.5:
            return f"{name()} {words(0, 3)} {pick(states).upper()}."
        if k == 4:
            return f"{name()} {words(0, 3)} {pick(states).upper()}. {pick(bodies).capitalize()} {words(1, 4)}{end}"
        if k == 5:
            return f"{name()} {words(1, 5)} {pick(trailing)}."
        if k == 6:
            return f"{rng.integers(1, 3000)} {words(2, 6)}{end}"
        if k == 7:
            return f"{word()[:3]}{name() if rng.random() < 0.5 else word()[:2].upper()} {words(2, 6)}{end}"
        if k == 8:
            return f"{name()} {words(1, 3)} {pick('ABDJKLMR')}. {pick('ABDJKLMR')}. {name()} {words(0, 3)}".rstrip() + end
        if k == 9:
            return f"{name()} {words(1, 4)} {rng.integers(0, 99)}.{rng.integers(0, 99)} {words(1, 4)}{end}"
        if k == 10:
            return f"{name()} {words(1, 3)} {pick('abcdefghijklmnopqrstuvwxyz')}{end}"
        return f"{pick('The It They He We This In You'.split())} {words(2, 8)}{end}"

    out = []
    for i in range(n):
        parts = [sentence() for _ in range(rng.integers(2, 6))]
        if i % 5 == 0:
            first, last, gap, mark = pick(SCRIPTS)
            parts = [gap.join("".join(chr(rng.integers(first, last)) for _ in range(rng.integers(1, 6))) for _ in range(rng.integers(3, 9))) + mark for _ in range(rng.integers(2, 6))]
        text, ends = "", set()
        for p in parts:
            text += (" " if rng.random() < 0.9 else "\n") * bool(text) + p
            ends.add(len(text))
        out.append((text.lower() if rng.random() < SMALL_SHARE else text, ends))
    return out


def placed(texts: list[tuple[str, set[int]]]) -> list:
    """Chains of texts whose ends are known."""
    out = []
    for text, ends in texts:
        found = candidates(text, 0, len(text))
        if found:
            out.append([(c, p - q, p in ends) for (p, c), q in zip(found, [0, *[p for p, _ in found]])])
    return out


def chains(texts: list[str], rng):
    """Sequences of (context, distance, boundary?) with their labels."""
    out, bare, small = [], [], []
    for text in texts:
        for start, end, prose in units(text):
            if prose >= end:
                continue
            found = candidates(text, prose, end)
            at = [p for p, _ in found]
            if found:
                out.append([(c, p - q, label(c)) for (p, c), q in zip(found, [prose, *at])])
                if rng.random() < SMALL_SHARE and len(text[prose:end].lower()) == end - prose:
                    small.append((text[prose:end].lower(), {p - prose for p, c in found if label(c)}))
            whole = text[prose:end].strip()
            if re.search(f"[{_BARE}]", whole) and not any(label(c) for _, c in found) and "\n" not in whole:
                bare.append(whole)
    return out + placed(strung(bare, rng, 4 * len(bare)) if bare else []) + placed(small)


def main(sf: str, epochs: int = 5) -> None:
    rng = np.random.default_rng(2)
    rows_ = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    out = {r["text"] for r in rows_ if r["doc_id"] % 10 == HELD}
    texts = [t for t in dict.fromkeys(r["text"] for r in rows_) if t and t not in out]
    texts = [texts[k] for k in rng.permutation(len(texts))[:MAX_TEXTS]]
    cut = len(texts) // 10
    held, data = chains(texts[:cut], rng), chains(texts[cut:], rng) + placed(made_up(rng, N_MADE))
    w, total = np.zeros(BUCKETS), np.zeros(BUCKETS)
    t, t_total, n, began = np.zeros((3, 2, 2)), np.zeros((3, 2, 2)), 0, time.time()
    rows: dict = {}
    for e in range(epochs):
        wrong = 0
        for k in rng.permutation(len(data)):
            chain, n = data[k], n + 1
            ids = [rows[c] if c in rows else rows.setdefault(c, hashed(features(*c))) for c, _, _ in chain]
            tags = decode([w[i].sum() for i in ids], [d for _, d, _ in chain], t)
            if any(g != y for g, (_, _, y) in zip(tags, chain)):
                wrong += 1
                for j, (g, (_, d, y)) in enumerate(zip(tags, chain)):
                    if g != y:
                        np.add.at(w, ids[j], 1.0 if y else -1.0)
                        np.add.at(total, ids[j], float(n) if y else -float(n))
                    if j:
                        a, b = (int(chain[j - 1][2]), int(y)), (int(tags[j - 1]), int(g))
                        if a != b:
                            for x, sign in ((a, 1.0), (b, -1.0)):
                                t[(distance(d), *x)] += sign
                                t_total[(distance(d), *x)] += sign * n
        tagger = Tagger(w - total / (n + 1), t - t_total / (n + 1))
        bad = seen = 0
        for chain in held:
            tags = decode([tagger.score(c) for c, _, _ in chain], [d for _, d, _ in chain], tagger.trans)
            bad, seen = bad + sum(g != y for g, (_, _, y) in zip(tags, chain)), seen + len(chain)
        print(f"epoch {e}: {wrong} of {len(data)} chains wrong; held out {bad} of {seen} places wrong; {time.time() - began:.0f} s", flush=True)
    np.savez_compressed(Path(__file__).parent.parent / MODEL, weights=(w - total / (n + 1)).astype("float16"), trans=(t - t_total / (n + 1)).astype("float16"))


if __name__ == "__main__":
    main(sys.argv[1])
