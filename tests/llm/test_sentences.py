import itertools
import random
from pathlib import Path

import numpy as np
import pytest

from docloom.llm.sentences import Tagger, candidates, decode, distance, sentences, units


def cut(text):
    return [text[a:b] for a, b in Tagger.shipped().sentences(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["According to Dr. Vostrani of the group, it is strict.", "See Fig. 38 and Sec. 2.6 for the file."],
        ["It moved to Tidewire Inc. in release No. 26.", "The U.S. and U.K. mirrors hash it."],
        ["Set it to 7.1 s, i.e. 92 ticks.", "It ships `a`, `b`, etc.", "Really?!", "Wait ... then retry."],
        ["The note reads: “Stop the host. Then lock it.”", "“Is it signed?” asks the checker, and it answers."],
        ["It failed at 4 p.m. on the host.", "(The cache is warm.)", "commit_page starts in lower case."],
        ["Der Wert beträgt 8,7 s, d. h. etwa 27 Takte.", "Am 3. Mai wurde es von Dr. Ostrelle geändert.", "Im Handbuch steht: „Erst sichern. Dann neu starten.“", "Wie groß ist es?"],
        ["Le guide précise : « Arrêtez tout. Videz ensuite `x`. »", "Pourquoi le tampon est-il vide ?", "« Faut-il relancer Sablemath ? » demande le journal."],
        ["¿Por qué está vacío el búfer?", "La Sra. Brankovel cambió `x` en el núm. 32.", "¡No llame a `x` dos veces!"],
        ["Поддерживаются Mossgrid, Willowdoc и т. д.", "Г. Brankovel переписал `x` в 2023 г. для Rooklint.", "Почему буфер пуст?"],
        ["Το όριο είναι 5,1 δευτ., δηλ. 81 κύκλοι.", "Γιατί είναι άδεια η ουρά;", "Μην καλείτε το `x` δύο φορές!"],
        ["लेखक हर संदेश को दोहराता है।", "डॉ. Hilbrecken ने `x` को बदला।", "कतार खाली क्यों है?"],
        ["غيّر د. Sundreth الخيار `x` في Sundialer.", "لماذا القائمة فارغة؟"],
        ["안내서는 \"먼저 멈추세요. 그다음 `x`를 부르세요.\"라고 말합니다.", "왜 캐시가 비어 있습니까?"],
        ["ค่าตั้งต้นคือ 5.9 วินาที", "เมื่อเรียก `x_y` แล้วตัวอ่านทิ้งไฟล์", "ทำไมคิวจึงว่าง", "ใน Ferrostat ตัวเขียนเรียงลำดับไฟล์เมื่อคิวว่าง"],
    ],
)
def test_spaced_scripts(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("- " + " ".join(parts)) == ["- " + parts[0], *parts[1:]]


@pytest.mark.parametrize(
    "parts",
    [
        ["「止めてください。次に`x`を呼びます。」と手引きに書かれています。", "待機中……それから再試行します。", "page.toml（例：Nettleauth用の設定。）を読み込みます。", "なぜ索引は空なのでしょうか？", "`x`を二度呼んではいけません！", "既定値は4.1秒です。"],
        ["手册写道：“先停止服务。再调用`x`。”", "等待……然后重试。", "不要重复调用`x`！", "默认值是4.3秒。"],
    ],
)
def test_unspaced_scripts(parts):
    assert cut("".join(parts)) == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["Mr. Smith went to St. Louis yesterday.", "He liked it."],
        ["Prof. J. K. Rowe of No. 5 St. James met Mrs. Lee.", "They spoke."],
        ["Am 3. Oktober war es kalt.", "Dann kam Schnee."],
        ["The U.S. Army moved.", "It rained."],
        ["He lives in the U.S.", "The army moved."],
        ["It is big.", "iPhone sales rose.", "macOS did too."],
        ["Version 2.0 is out.", "3 users like it."],
        ["see fig. 3 for it.", "then go on.", "it works."],
        ["မြန်မာစာ ဖြစ်သည်။", "နောက်တစ်ခု ဖြစ်သည်။"],
        ["នេះជាប្រយោគ។", "នេះជាប្រយោគទីពីរ។"],
        ["བོད་ཡིག་ཡིན།", "གཉིས་པ་ཡིན།"],
        ["ሰላም ነው።", "ደህና ነው።"],
    ],
)
def test_beyond_the_tables(parts):
    assert cut(" ".join(parts)) == parts


def test_missing_space_before_an_initial():
    assert cut("It is nested.J. K. Dorvane wrote `x`. So") == ["It is nested.", "J. K. Dorvane wrote `x`.", "So"]
    assert cut("Les données.M. Sundreth a réécrit `x`.") == ["Les données.", "M. Sundreth a réécrit `x`."]


def test_layout():
    text = "# Head. One\nA line\ngoes on. Next one\n\n- item a. More\n- item b\n  goes on\n1. first\n```py\nx = 1. Y\n\n```\nend"
    assert cut(text) == ["# Head. One", "A line\ngoes on.", "Next one", "- item a.", "More", "- item b\n  goes on", "1. first", "```py\nx = 1. Y\n\n```", "end"]
    assert cut("release No.\n46. Index archives it. So") == ["release No.\n46.", "Index archives it.", "So"]
    assert cut("```\nopen. Fence") == ["```\nopen. Fence"]
    assert cut("") == cut(" \n\t\n") == []


def test_units_tile_the_lines():
    rng = random.Random(3)
    bits = ["# h", "text. More", "- a", "2) b", "```", "", "  ", "~~~", "> q", "| t |", "…", "　。"]
    for _ in range(300):
        text = "\n".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        spans = units(text)
        assert all(a <= p <= b for a, b, p in spans) and all(x[1] < y[0] or x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        found = Tagger.shipped().sentences(text)
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in found)
        assert "".join("".join(text[a:b] for a, b in found).split()) == "".join(text.split())


def test_viterbi_against_all_taggings():
    rng = np.random.default_rng(5)
    trans = rng.normal(0, 1, (3, 2, 2)).tolist()
    for _ in range(100):
        n = rng.integers(1, 9)
        s, d = rng.normal(0, 2, n).tolist(), rng.integers(1, 30, n).tolist()

        def value(tags):
            return sum(x for x, t in zip(s, tags) if t) + sum(trans[distance(d[k])][tags[k - 1]][tags[k]] for k in range(1, n))

        best = max(itertools.product([0, 1], repeat=int(n)), key=value)
        assert value(best) == pytest.approx(value([int(t) for t in decode(s, d, trans)]))


def test_rows(spark):
    rows = [(1, "One. Two.", 3), (1, "One. Two.", 3), (2, None, 3), (3, "", 3), (4, "\n\n", 3), (5, "A b c. " * 30_000, 3), (None, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sent_start int")
    got = sentences(df, item_id="doc_id", text="text", with_text=True).collect()
    assert sorted((r.sent_start, r.sent_end, r.sentence) for r in got if r.doc_id == 1) == [(0, 4, "One."), (5, 9, "Two.")]
    assert sum(r.doc_id == 5 for r in got) == 30_000 and {r.doc_id for r in got} == {1, 5, None}
    assert sentences(df.limit(0), item_id="doc_id", text="text").count() == 0


def test_held_out_accuracy(spark):
    """Against the training rules, on other documents than the training ones: those never trained on, or another table's."""
    from docloom.llm.training.fit_sentences import HELD
    from docloom.llm.training.sentence_labels import label

    other = Path("/root/testdata/check_s").exists()
    sf = "/root/testdata/check_s" if other else "/root/testdata/sf0.01"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id % 10 = {HELD} and text is not null").select("text").collect()]
    tagger, wrong, seen = Tagger.shipped(), 0, 0
    for t in texts:
        for a, b, p in units(t):
            if p < b:
                ends = set(tagger.ends(t, p, b))
                for at, c in candidates(t, p, b):
                    wrong, seen = wrong + ((at in ends) != label(c)), seen + 1
    assert seen > (5000 if other else 1000) and wrong < 0.002 * seen
