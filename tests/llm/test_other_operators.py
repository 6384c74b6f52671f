"""Pages, conversations, vectors and the pipeline on small tables with every awkward case."""

import hashlib
import json

import numpy as np
import pytest

from mercalith.llm.chat import digests, format_and_read, formatted, json_turns, read_piece, table_turns
from mercalith.llm.components import components
from mercalith.llm.extraction import extract, host, main_text
from mercalith.llm.vectors import SmallWorld, audited_beam, near_vectors


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>a<p>b", "a b"),
        ("x < y & z", "x < y & z"),
        ('<div class="ad">no</div><p>yes</p>', "yes"),
        ("<article><header><h1>T</h1></header><p>a<b>b</b>c</p><div class='comments'><p>no</p></div></article><footer>f", "T abc"),
        ("<!-- c --><p>q<!-- unclosed", "q"),
        ("<script>if(a<b){}</script><p>ok</p>", "ok"),
        ("<style>x", ""),
        ("<p>a&nbsp;b&#8212;c&copy; &amp;lt;</p>", "a b—c© &lt;"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ('<p title="a>b">z</p>', "z"),
        ("<div hidden>h</div>t", "t"),
        ("<main><p>m</p></main><aside>s</aside>", "m"),
        ("<p>a<br>b\n  c</p>", "a b c"),
        ("<nav><ul><li>x</ul></nav><h1>A</h1>B<form>f</form>", "A B"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<p>a</span></div></p>b", "a b"),
        ("<" * 2000 + "<a " * 500, "<" * 2000),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_templates_recur_on_a_host(spark):
    pages, want = [], {}
    for i in range(30):
        # no article element: only recurrence tells that the two blocks are not the page's own
        pages.append((i, f"http://a.example/{i}", f"<div><span>Site name</span></div><div>own {i}</div><div>All <b>rights</b></div>"))
        want[i] = f"own {i}"
    for i in range(30, 60):  # prose in an article stays however often it recurs
        pages.append((i, f"http://b.example/{i}", f"<article><p>same</p><p>own {i}</p><div><em>Share</em></div></article>"))
        want[i] = f"same own {i}"
    for i in range(60, 70):  # copies of one page are one page
        pages.append((i, "http://c.example/", "<div>once</div>"))
        want[i] = "once"
    pages += [(70, None, "<div>once</div>"), (71, "no url", None), (None, "http://a.example/x", "<p>q</p>")]
    want |= {70: "once", 71: "", None: "q"}
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "1 AS host", "2 AS copy")
    assert {r.page_id: r.text for r in extract(df).collect()} == want
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "inside",
    [
        '<div class="post-header"><h1>T</h1></div>', '<p class="related">T</p>', '<h2 id="social">T</h2>', '<section class="related-work"><p>T</p></section>',
        '<p class="notice-period">T</p>', '<div class="ad-hoc">T</div>', '<section id="notice">T</section>', "<p><math><mi>T</mi></math></p>", "<svg><text>T</text></svg>",
    ],
)
def test_an_article_keeps_its_own(inside):
    assert main_text(f"<article><p>a</p>{inside}<div class='ad'>no</div><ul class='comments'><li>no</li></ul></article>").split() == ["a", "T"]


def plain_templates(pages):
    """{host: (exact, shapes)} as nested tuples, counted in plain Python over what the second reading may delete."""
    from mercalith.llm import extraction as x
    from mercalith.llm.markup import parse

    def exact(e):
        return (e.name, e.marks.get("class", ""), *[" ".join(c.split()) if isinstance(c, str) else exact(c) for c in e.children if not isinstance(c, str) or c.split()])

    def shape(e):
        out = []
        for c in e.children:
            if not isinstance(c, str) and (not out or out[-1] != shape(c)):
                out.append(shape(c))
        return (e.name, e.marks.get("class", ""), *out)

    def chars(e):
        return sum(len(" ".join(c.split())) if isinstance(c, str) else chars(c) for c in e.children)

    def walk(e, inside):
        inside = inside or e.name in ("article", "main")
        yield e, inside
        if not (inside and e.name in x._PROSE):
            for c in e.children:
                if not isinstance(c, str):
                    yield from walk(c, inside)

    size = lambda s: 1 + sum(size(c) for c in s[2:])
    marked = lambda s: bool(s[1]) or any(map(marked, s[2:]))
    prose = lambda s: s[0] in x._PROSE or any(map(prose, s[2:]))
    by_host = {}
    for name, source in set(pages):
        on = {}
        for e, inside in walk(parse(source), False):
            if x._may_recur(e, inside):
                on["exact", exact(e)] = chars(e)
                s = shape(e)
                if not prose(s) and (marked(s) or size(s) > 2):
                    on["shape", s] = max(on.get(("shape", s), 0), chars(e))
        by_host.setdefault(name, []).append(on)
    out = {}
    for name, found in by_host.items():
        for kind, share in (("exact", x.RECURS_SHARE), ("shape", x.SHAPE_SHARE)):
            for s in {k for on in found for k in on if k[0] == kind}:
                lengths = [on[s] for on in found if s in on]
                if len(lengths) >= x.RECURS_ON and len(lengths) >= share * len(found):
                    if kind == "exact" or max(lengths) <= max(x.SHORT_TEXT, 2 * min(lengths)):
                        out.setdefault(name, set()).add(s)
    return out


def test_templates_are_those_that_plain_counting_finds(spark):
    from mercalith.llm import extraction as x
    from mercalith.llm.markup import parse

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id", "url", "html")
    pages = rows.select(x.host(rows.url).alias("host"), "html").where("host <> '' AND html IS NOT NULL")
    got = {}
    for r in x.templates(pages).collect():
        got.setdefault(r.host, set()).add((r.by_shape, r.subtree))
    want = plain_templates([(r.host, r.html) for r in pages.collect()])
    assert {h: len(s) for h, s in got.items()} == {h: len(s) for h, s in want.items()}
    # the template step changes pages by itself: without any rule on markup, menus and footers go
    changed = 0
    for r in pages.collect():
        shapes = {h for by_shape, h in got.get(r.host, ()) if by_shape}
        exact = {h for by_shape, h in got.get(r.host, ()) if not by_shape}
        root = parse(r.html)
        before = x._text_of(root, {}, set(), set(), False)
        found = x.subtrees(root)
        names = {e.name for e in _elements(root) if shapes and found[id(e)].shape in shapes}
        changed += bool(names & {"nav", "footer"} or exact & {found[id(e)].exact for e in _elements(root)})
        assert len(before) > 0 or not r.html
    assert changed > 50


def _elements(root):
    stack = [root]
    while stack:
        e = stack.pop()
        yield e
        stack += [c for c in e.children if not isinstance(c, str)]


def test_shapes_recur_whatever_they_say(spark):
    """No article, and menus that differ by page."""
    pages = [
        (i, f"http://h.example/{i}", f"<div class='bar'><a>go {i}</a><a>to {i * 7}</a></div><div>own {i} {'word ' * (i * 40)}</div><ul><li><a>x{i}</a></li><li><a>y</a></li></ul>")
        for i in range(12)
    ]
    pages += [(50 + i, f"http://few.example/{i}", f"<div class='bar'><a>go {i}</a></div>own {i}") for i in range(3)]
    pages += [(70 + i, f"http://only.example/{i}", f"<div class='x'><i>only {i}</i></div>") for i in range(9)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        assert got[i].split() == ["own", str(i), *["word"] * (i * 40)]
    assert all(got[50 + i] == f"go {i} own {i}" for i in range(3))  # too few pages to tell
    assert all(got[70 + i] == f"only {i}" for i in range(9))  # shapes never leave a page without text


def test_host(spark):
    df = spark.createDataFrame([("HTTP://U@Www.Example.org:80/a?b",), ("//x.y/z",), ("nothing",), (None,)], "url string")
    assert [r[0] for r in df.select(host(df.url)).collect()] == ["www.example.org", "x.y", "", ""]


SAID = ["plain", "", "\\", "### Assistant: </turn>", "a\\#b<c>\n### user: x </turn>\n", ": \\: #:<", "é😀", None]


def test_chat_round_trip(spark):
    rows = [(i % 5, i, ["user", "assistant", "sys:tem", None][i % 4], SAID[i % len(SAID)]) for i in range(64)]
    rows += [(None, 0, "assistant", "no id"), (9, None, "assistant", "no turn"), (9, 1, "user", "tie"), (9, 1, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    pieces = formatted(table_turns(df)).collect()
    assert sorted(read_piece(p.formatted) for p in pieces) == sorted((r[2] or "", r[3] or "") for r in rows)
    got = {r.conv_id: r for r in format_and_read(table_turns(df.selectExpr("*", "1 AS formatted", "2 AS n"))).collect()}
    for c in range(5):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(own), len(said))
        assert r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars == sum(len(p.formatted) for p in pieces if p.conv_id == c)
    assert got[None].n_turns == 1 and got[9].n_turns == 3
    assert digests(formatted(table_turns(df.limit(0)))).count() == 0


def test_layouts_are_recognised(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "id": 3},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"instruction": "a", "input": "", "output": "b", "source": {"deep": [1]}},
        {"prompt": "a", "response": "b"},
        {"question": "a", "answer": "b"},
    ]
    texts = [json.dumps(r) for r in records] + ["not json", "[1]", None]
    df = spark.createDataFrame(list(enumerate(texts)), "conv_id bigint, record string")
    got = {}
    for r in json_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(got[i] == [("user", "a"), ("assistant", "b")] for i in range(5))
    assert [got[i] for i in (5, 6, 7)] == [[("unknown", "not json")], [("unknown", "[1]")], [("unknown", "")]]
    table = spark.createDataFrame([(1, "do", "with", "done"), (2, "do", None, "done")], "conv_id bigint, instruction string, input string, output string")
    assert sorted(map(tuple, table_turns(table).collect())) == [
        (1, 0, "user", "do"), (1, 1, "user", "with"), (1, 2, "assistant", "done"), (2, 0, "user", "do"), (2, 1, "assistant", "done"),
    ]
    with pytest.raises(ValueError):
        table_turns(spark.createDataFrame([(1,)], "something int"))


def test_no_turn_vanishes(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, "loose", 5, {"role": "assistant", "content": [{"type": "text", "text": "b"}, "c", {"url": "u"}]}]},
        {"messages": []},
        {"conversations": [{"from": "human", "value": None}, {"other": 1}]},
        {"messages": "no list"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id bigint, record string")
    got = {}
    for r in json_turns(df).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[0] == [("user", "a"), ("unknown", "loose"), ("unknown", "5"), ("assistant", 'bc{"url": "u"}')]
    assert got[1] == [("", "")]
    assert got[2] == [("user", ""), ("unknown", '{"other": 1}')]
    assert len(got[3]) == 1 and got[3][0][0] == "unknown"
    table = spark.createDataFrame([(1, []), (2, None), (3, [("user", "x")])], "conv_id bigint, messages array<struct<role: string, content: string>>")
    assert sorted((r.conv_id, r.turn, r.role, r.text) for r in table_turns(table).collect()) == [(1, 0, "", ""), (2, 0, "", ""), (3, 0, "user", "x")]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    links = chain + [(1000, 1001), (1001, 1000), (7, 7), (None, 3), (500, 400), (500, 401), (450, 401)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000} | {i: 400 for i in (400, 401, 450, 500)}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_graph_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 24))
    v = np.concatenate([b + 0.03 * rng.normal(size=(20, 24)) for b in base])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = SmallWorld.build(v)
    beam = audited_beam(graph, 0.98)
    got = len(graph.above(graph.vectors, 0.98, beam)[0])
    assert got >= 0.97 * (v @ v.T >= 0.98).sum()


@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_near_vectors(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for label in (1, 2, None):
        base = rng.normal(size=(25, 16))
        for b in base:
            for _ in range(int(rng.integers(1, 6))):
                rows.append((at, (b + 0.02 * rng.normal(size=16)).tolist(), label))
                at += 1
    rows += [(at + i, rows[0][1], 1) for i in range(30)]  # copies
    at += 30
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1e300] * 16]
    rows += [(at + i, v, 1) for i, v in enumerate(odd)] + [(None, rows[0][1], 1), (3, rows[3][1], 1), (at + 50, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "1 AS node", "2 AS shard", "3 AS n")
    got = near_vectors(df.repartition(3), shard_rows=shard_rows).collect()
    assert len(got) == len(rows)
    units = []
    for _, v, label in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append((np.array(v) / max(map(abs, v)), label) if good else None)

    def linked(a, b):
        if a is None or b is None or a[1] != b[1] or len(a[0]) != len(b[0]):
            return False
        return a[0] @ b[0] / np.linalg.norm(a[0]) / np.linalg.norm(b[0]) >= 0.98

    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    count = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if linked(units[i], units[j]):
                count[i] += 1
                count[j] += 1
                parent[root(i)] = root(j)
    first = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            first[root(i)] = min(first.get(root(i), r[0]), r[0])
    want = sorted((r[0] is None, r[0] or 0, count[i], first.get(root(i))) for i, r in enumerate(rows))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors(df.limit(0)).count() == 0
    # labels of any type, also beyond 32 bits
    for label in ("concat('label ', label)", "CAST(label AS BIGINT) + 5000000000"):
        other = near_vectors(df.selectExpr("vec_id", "embedding", f"{label} AS label"), shard_rows=shard_rows)
        key = lambda r: repr((r.vec_id, r.n_links, r.component_id, r.kept))
        assert sorted(map(key, other.collect())) == sorted(map(key, got))


def test_pipeline_stages_follow_their_operators(spark):
    import corpus_pipeline as p
    from mercalith.llm.mixing import mix
    from mercalith.llm.quality import quality
    from mercalith.llm.simhash import near_duplicates
    from mercalith.llm.substrings import remove_repeats

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    kept = p.quality_rules(spark, docs, sf_dir).cache()
    assert kept.columns == columns and ids(kept) == ids(quality(docs, labels).filter("kept"))
    single = p.simhash_near_dedup(spark, kept, sf_dir).cache()
    assert single.columns == columns and ids(single) == ids(near_duplicates(kept).filter("doc_id = component_id"))
    cut = p.substring_dedup(spark, single, sf_dir).cache()
    shorter = {r.doc_id: r for r in remove_repeats(single).collect()}
    before = {r.doc_id: r.text for r in single.collect()}
    assert cut.columns == columns and ids(cut) == ids(single)
    for r in cut.collect():
        assert r.text == (shorter[r.doc_id].kept_text if shorter[r.doc_id].n_removed else before[r.doc_id])
        assert r.n_chars == len(r.text)
    mixed = p.source_mix(spark, cut, sf_dir).cache()
    want = {r.doc_id: r.taken // r.size for r in mix(cut).filter("size > 0").collect()}
    got = {}
    for i in ids(mixed.filter("length(trim(text)) > 0")):
        got[i] = got.get(i, 0) + 1
    assert mixed.columns == columns and got == {i: n for i, n in want.items() if n}
    last = p.run(spark, sf_dir)
    assert ids(last) == ids(mixed)
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_with_awkward_rows(spark, tmp_path):
    """Repeated and NULL ids, NULL texts, further columns with the names of results."""
    import corpus_pipeline as p

    words = "the of river stone light house and in was on".split()
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice(words, n)) + " " + " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 20))
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"{text(60)} {shared if i % 4 == 0 else ''}", "en", f"s{i % 3}") for i in range(60)]
    rows += [(7, text(50), "en", "s0"), (7, text(10) + " " + shared, "de", None), (7, "short", "en", "s0"), (None, text(70), None, "s1"), (None, None, None, None)]
    rows += [(61, None, "en", "s1"), (62, "", "en", "s1"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", "1 AS sig", "'x' AS kept", "2 AS _key", "3 AS size", "4 AS passages", "5 AS fingerprint")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for i, (name, stage) in enumerate(p.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or now.columns == docs.columns, name
    assert now.count() > 20
    assert p.run(spark, str(tmp_path)).count() == now.count()
