import pyarrow as pa
import pytest

from docloom.llm import residue
from docloom.llm.residue import classify, is_filler, markdown_lines, markdown_of, mask, message, residue_pages, without_residue

HTML = "<!DOCTYPE html><html><head><title>{{ t }}</title><script>var a='${x}';</script></head><body><nav><a href='/'>404</a></nav>{}<footer>RSS</footer></body></html>"


def page(body):
    return HTML.replace("{}", body)


@pytest.mark.parametrize(
    "text,kind",
    [
        ("{% block summary %}{% endblock %}", "placeholder"),
        ("It works. Install {{package}} with the steps below.", "placeholder"),
        ("Dear {first_name}, thanks for trying it.", "placeholder"),
        ("Hello undefined, your plan is [object Object].", "placeholder"),
        ("[Insert short description here]", "placeholder"),
        ("TBD – add the parameters here.", "placeholder"),
        ("&lt;PLACEHOLDER&gt; section to come", "placeholder"),
        ("404 – Not Found", "error"),
        ("Too many requests", "error"),
        ("お探しのページは移動または削除されました。", "error"),
        ("Please enable JavaScript to view this page.", "scripts"),
        ("Diese Seite befindet sich im Aufbau.", "announced"),
        ("Lorem ipsum dolor sit amet.", "filler"),
        ("xxx xxx xxx xxx xxx xxx", "filler"),
        ("Reference id: 5-5-5.", "weak"),
        ("The handler answers with 404 Not Found unless strict mode is on.", ""),
        ("Visitors who have not enabled JavaScript still see the list as plain text.", ""),
        ("Our theme shows lorem ipsum in the preview until the cache has real data.", ""),
        ("The word TODO in a comment is listed by the scanner.", ""),
        ("Write `c` to print a field; the `c` tag tests it.", ""),
        ("The guide says “TODO: write this section” where text is missing.", ""),
        ("A value of `c` becomes NaN in the reader.", ""),
        ("[Overview](#overview)", ""),
        ("Use List<String> or Map<Key, Value> here.", ""),
        ("The __init__ method runs before __PRODUCT_NAME.", "placeholder"),
        ("The __init__ method runs first.", ""),
        ("None.", ""),
        ("Access denied is logged when the planner sees an expired token.", ""),
    ],
)
def test_classes(text, kind):
    assert classify(text) == kind


@pytest.mark.parametrize(
    "text,kind",
    [
        ("Sorry, the page you are looking for could not be found.", "error"),
        ("We're sorry, but something went wrong.", "error"),
        ("Service temporarily unavailable", "error"),
        ("This page isn't working right now", "error"),
        ("Esta página no existe", "error"),
        ("The requested URL was not found on this server.", "error"),
        ("Please turn JavaScript on and reload the page.", "scripts"),
        ("Under construction", "announced"),
        ("This section is being written.", "announced"),
        ("Lorem ipsum.", "filler"),
        ("Curabitur sodales ligula in libero. Sed dignissim lacinia nunc curabitur tortor.", "filler"),
        ("The page was moved to the new index by the scheduler.", "sounds"),
        ("The cache is not available.", "sounds"),
        ("The page cache holds sixty entries.", ""),
        ("Not found. Request handlers are cached by the scheduler.", ""),
        ("We are sorry. " + "The page you asked for does not exist or has moved. " * 5, "error"),
    ],
)
def test_messages_in_other_words_and_lengths(text, kind):
    assert message(mask(text)) == kind


def test_links_are_their_labels():
    line = "- [Object store](../stage-route/) and [object store](https://docs.example/a) by [insert mode](/m) of ![object lock](x.png)"
    assert markdown_lines(line) == [(1, False, "- Object store and object store by insert mode of object lock")]
    assert classify(markdown_lines(line)[0][2]) == "" and classify("It is [object Object].") == "placeholder" and classify("[insert name]") == "placeholder"


def test_blocks_are_what_a_reader_sees():
    text = page("<main><h1>A &amp; B</h1><p>x <code>${v}</code> <a href='/k'>k</a>\nl</p><pre><code>{{ y }}</code></pre><ul><li>i</li></ul><table><tr><td>a</td><td>b</td></tr></table><!-- TODO: z --></main>")
    assert markdown_of(text) == "# A & B\n\nx `c` [k](/k) l\n\n```\n```\n\n- i\n\n| a | b |"
    assert [(h, b) for _, h, b in markdown_lines(markdown_of(text))] == [(True, "A & B"), (False, "x `c` k l"), (False, "`c`"), (False, "- i"), (False, "| a | b |")]
    assert markdown_of("<html><body><div id='root'></div><noscript>JavaScript is required.</noscript></body></html>") == "JavaScript is required."
    assert is_filler("dolor sit amet lorem") and not is_filler("dolor")
    assert [b for *_, b in markdown_lines("~~~\n```\nTODO: x\n~~~\nout")] == ["`c`", "out"]


def test_cases(spark):
    real = "<p>The scheduler drops stale entries after the first call.</p>"
    rows = [
        (1, "https://a.example/x", page("<main><h1>Oops!</h1><p>Reference id: 1-2-3.</p><pre>trace</pre></main>")),
        (2, "https://a.example/x", page(f"<main><h1>Oops!</h1>{real}</main>")),
        (3, "https://a.example/x", page(f"<noscript>JavaScript is required.</noscript><main>{real}</main>")),
        (4, "https://b.example/x", page(f"<main>{real}<p>Ask @@ALIAS@@ for access.</p></main>")),
        (5, "https://b.example/x", page("<main><p>Reference id: 9-9-9.</p><p>Page not found</p></main>")),
        (6, "https://c.example/x", page("<main><p>Page not found</p><p>Reference id: 7-7-7.</p></main>")),
        (7, None, None),
        (8, None, ""),
        (9, "not a url", "# Coming soon\n\nNothing here yet – check back later!"),
        (10, "https://d.example/", "# Real\n\n```\n{{ x }}\nTODO: y\n```\n\nA `${HOME}` value is read at the start."),
        (11, "https://d.example/", " ".join(f"w{chr(97 + i % 26)} stays" for i in range(50_000))),
        (12, "https://d.example/", page("")),
        (13, "https://d.example/", page("<main><p>go back</p></main>")),
    ]
    df = spark.createDataFrame([(*r, "c") for r in [*rows, rows[0]]], "id long, url string, body string, source string")
    cases = residue_pages([("t", df, "id", "url", "body")])
    got = sorted(r.row_id for r in cases.collect())
    assert got == [1, 4, 5, 6, 9]  # 13's weak phrase stands on one site only
    left = sorted(r.id for r in without_residue(df, cases, src_table="t", row_id="id").collect())
    assert left == [2, 3, 7, 8, 10, 11, 12, 13]
    assert residue_pages([("t", df.limit(0), "id", "url", "body")]).count() == 0


def test_messages_in_unknown_words_are_found_by_recurrence(spark):
    lost = "Hakemaasi sivua ei ole enää palvelimella, tai sen osoite on muuttunut. Tarkista osoite, siirry etusivulle tai käytä hakua; voit myös kirjoittaa ylläpidolle, jos luulet, että vika on meidän."
    note = "This option is old and will go with the next release."
    rows = [(i, f"https://s{i}.example/p{i}", page(f"<main><h1>Hups</h1><p>{lost}</p></main>")) for i in range(4)]
    rows += [(10 + i, f"https://s{i}.example/q{i}", f"# Hups\n\n{lost}") for i in range(2)]
    rows += [(20 + i, f"https://m{i}.example/docs/same", page("<main><p>A mirrored page says this on each of its hosts.</p></main>")) for i in range(4)]
    rows += [(30 + i, f"https://r{i}.example/o{i}", page(f"<main><p>{note}</p><p>Option number {'abcdef'[i]} sets what the reader does first.</p></main>")) for i in range(6)]
    rows += [(40, "https://r1.example/short", page(f"<main><p>{note}</p></main>"))]
    rows += [(50 + i, "https://one.example/" + "xyzw"[i], page("<main><p>Ei täällä.</p></main>")) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, url string, body string")
    assert len(lost) > 160 and not classify(lost)
    assert sorted(r.row_id for r in residue_pages([("t", df, "id", "url", "body")]).collect()) == [0, 1, 2, 3, 10, 11]


def test_furniture_and_content_types(spark):
    real = "The scheduler drops stale entries after the first call, as `drain_page()` does."
    side = "- [Overview](../overview/)\n- [{{ page.title }}](../other/)\n- [Coming soon](../soon/)\n"
    rows = [
        (1, f"{side}\n# Using the scheduler\n\n{real}\n", None),  # furniture's placeholders are not the article's
        (2, "<p>Not found</p>", "text/html; charset=utf-8"),
        (3, "<html><body><p>" + real + "</p></body></html>", "text/plain"),
        (4, "<html> is the first tag. It opens what {{ name }} reads.", "text/plain"),
        (5, page(f"<div><a href='/a'>Overview</a></div><main><h1>It</h1><p>{real}</p></main>"), None),
    ]
    df = spark.createDataFrame([(i, f"https://s{i}.example/{i}", t, k) for i, t, k in rows], "id long, url string, body string, kind string")
    assert sorted(r.row_id for r in residue_pages([("t", df, "id", "url", "body", "kind")]).collect()) == [2, 4]


def test_a_line_that_recurs_is_masked_once(monkeypatch):
    masked = []
    residue._short_read.cache_clear()
    monkeypatch.setattr(residue, "mask", lambda block: masked.append(block) or mask(block))
    texts = [f"# Part {i}\n\nA line that every one of these pages has in its text.\n\nPage {i} alone says this.\n" for i in range(20)]
    ids = list(range(20))
    batch = pa.RecordBatch.from_pydict({"i": ids, "s": [f"s{i}.example" for i in ids], "n": [f"p{i}" for i in ids], "t": texts, "k": pa.nulls(20, "string")})
    rows = pa.Table.from_batches(residue._pages(iter([batch]))).to_pylist()
    residue._short_read.cache_clear()
    assert [r["row_id"] for r in rows] == ids and sum(len(r["blocks"]) for r in rows) >= 40
    assert masked.count("A line that every one of these pages has in its text.") == 1 and len(masked) == len(set(masked))


def test_ordinary_lines_are_not_searched_for_placeholders(monkeypatch):
    class Never:
        def search(self, block):
            raise AssertionError(block)

    monkeypatch.setattr(residue, "_MARKS", Never())
    assert not residue.has_placeholder("Der Zähler steht auf 12, the reader waits until it is 14 – お待ちください。")
    for mark in ("{", "<", "%", "@", "[", "&lt;", "__", "TODO", "FIXME", "TBD", "TBC", "XXX", "replace", "Replace", "REPLACE", "undefined", "Undefined", "UNDEFINED", "nan", "naN", "Nan", "NaN", "NAN", "null", "Null", "NULL"):
        with pytest.raises(AssertionError):
            residue.has_placeholder(f"Größe ist {mark} hier")


@pytest.mark.parametrize(
    "text,masked",
    [
        ("Updated 2024-05-06  at 12:30", "updated 0 at 0:0"),
        ("Am 3. März 2024 geändert", "am 0 geändert"),
        ("May 5, 2024: 3 items", "0: 0 items"),
        ("Seite ١٢٣ von 20", "seite 0 von 0"),
        ("See https://a.example/1/2024-05-06 now", "see address now"),
        ("- **No digits here**", "no digits here"),
        ("Größe ohne Ziffern", "größe ohne ziffern"),
        ("Build 12345 of 99", "build 0 of 0"),
    ],
)
def test_masks(text, masked):
    assert mask(text) == masked
