import random

import pytest
from pyspark.sql import functions as F

from mapengine.model import TOP_LEVEL
from mapengine.operators import order, profile, shape
from mapengine.plans.wrangle import wrangle
from mapengine.sources import lexical, markup, nesting
from tests import fixtures as fx


@pytest.fixture
def write(tmp_path):
    def to_file(text, name="map.xml"):
        target = tmp_path / name
        target.write_text(text, encoding="utf-8")
        return str(target)

    return to_file


def collected(df):
    return [tuple(r) for r in df.collect()]


def test_small_counts(spark, write):
    elements = markup.elements(markup.events(spark, write(fx.small())))
    assert dict(collected(profile.count_tags(elements))) == {
        "map": 1, "way": 3, "node": 7, "relation": 2, "nd": 6, "tag": 10, "member": 5,
    }
    assert profile.count_users(elements).first().n == 4
    assert {r.uid for r in profile.distinct_users(elements).collect()} == {"11", "12", "13", "14"}
    classes = profile.key_classes(elements.where("name = 'tag'"))
    assert dict(collected(classes)) == {"lower": 6, "lower_colon": 2, "problemchars": 1, "other": 1}


def test_empty_extract(spark, write):
    elements = markup.elements(markup.events(spark, write("")))
    assert profile.count_tags(elements).count() == 0
    assert dict(collected(profile.key_classes(elements))) == {
        "lower": 0, "lower_colon": 0, "problemchars": 0, "other": 0,
    }


def test_top_level_elements_with_children_in_order(spark, write):
    rows = markup.events(spark, write(fx.small()))
    top = markup.top_level(rows).orderBy(*markup.POSITION)
    assert [(r.name, r.id) for r in top.collect()] == [
        ("way", "71"), ("node", "31"), ("node", "32"), ("relation", "90"), ("node", "33"), ("way", "72"),
        ("node", "34"), ("node", "35"), ("way", "73"), ("node", "36"), ("node", "37"), ("relation", "91"),
    ]
    assert markup.top_level(rows, ("node", "way")).count() == 10
    kids = order.children(rows).orderBy(*markup.POSITION).select("name", "parent.name", "parent.id", "position")
    assert collected(kids) == [
        ("tag", "way", "71", None), ("nd", "way", "71", 0), ("nd", "way", "71", 1), ("tag", "way", "71", None),
        *[("tag", "node", "32", None)] * 2,
        ("tag", "relation", "90", None), ("member", "relation", "90", None),
        ("tag", "node", "33", None),
        *[("nd", "way", "72", i) for i in range(3)], ("tag", "way", "72", None), ("nd", "way", "72", 3),
        *[("tag", "node", "36", None)] * 3,
        *[("member", "relation", "91", None)] * 4,
    ]


def test_attribute_text(spark, write):
    text = fx.document(
        fx.node(1, children=[
            '<tag k="a &amp; b" v="O&amp;K &lt;x&gt; &quot;q&quot; &apos;"/>',
            "<tag k='single \"quoted\"' v='it > that'/>",
            '<tag k="  outer  " v=""/>',
            '<tag k="&#233;&#x20AC;" v="é€𝄞"/>',
            '<tag k="line&#10;feed" v="raw\nfeed\tand tab"/>',
            '<tag\n  k = "spread"\n  v = "out"\n/>',
            '<tag k="paired" v="tags"></tag>',
        ]),
    )
    tags = markup.elements(markup.events(spark, write(text))).where("name = 'tag'").orderBy("seq")
    assert collected(tags.select("k", "v")) == [
        ("a & b", "O&K <x> \"q\" '"),
        ('single "quoted"', "it > that"),
        ("  outer  ", ""),
        ("é€", "é€𝄞"),
        ("line\nfeed", "raw feed and tab"),
        ("spread", "out"),
        ("paired", "tags"),
    ]


def test_missing_attributes_are_null_and_others_dropped(spark, write):
    rows = markup.events(spark, write(fx.document('<node id="1" color="red"/>')))
    row = rows.where("name = 'node'").first()
    assert (row.id, row.user, row.lat) == ("1", None, None)
    assert "color" not in rows.columns


def test_many_and_long_attributes(spark, write):
    many = " ".join(f'a{i}="{i}"' for i in range(900))
    text = fx.document(f'<node {many} id="1"/>', f'<node id="2" user="{"x" * 300_000}"/>')
    rows = markup.events(spark, write(text)).where("kind = 'node'").orderBy("seq").collect()
    assert [(r.id, len(r.user or "")) for r in rows] == [("1", 0), ("2", 300_000)]


def test_comments_and_declarations(spark, write):
    text = '<?xml version="1.0"?>\n<!DOCTYPE map>\n<!-- a > b -->\n<map>\n<!-- c --><node id="1"/>\n</map>'
    names = [r.name for r in markup.elements(markup.events(spark, write(text))).orderBy("seq").collect()]
    assert names == ["map", "node"]


@pytest.mark.parametrize("text", [
    '<map><node id=1/></map>',
    '<map><node id="1</map>',
    '<map><node id="a&b"/></map>',
    'no markup<map/>',
])
def test_what_is_no_plain_markup_stops_the_scan(spark, write, text):
    with pytest.raises(Exception, match="not plain markup|MALFORMED"):
        markup.events(spark, write(text)).collect()


def test_positions_ignore_other_children_and_repeat_refs(spark, write):
    text = fx.document(
        fx.way(1, children=[fx.nd(5), fx.tag("a", "b"), fx.nd(6), fx.nd(7), fx.tag("c", "d"), fx.nd(5)]),
        fx.way(2, children=[fx.tag("a", "b")]),
        fx.way(3, children=[fx.nd(9)]),
        fx.way(1, children=[fx.nd(1), fx.nd(2)]),  # a later version of the same path
    )
    kids = order.children(markup.events(spark, write(text)))
    assert sorted(collected(shape.way_node_positions(kids))) == sorted([
        ("1", "5", 0), ("1", "6", 1), ("1", "7", 2), ("1", "5", 3), ("3", "9", 0),
        ("1", "1", 0), ("1", "2", 1),
    ])


def test_children_outside_an_element_have_no_parent(spark, write):
    text = fx.document(fx.node(1, children=[fx.tag("a", "b")]), fx.tag("stray", "x"), fx.nd(3), fx.node(2))
    rows = markup.events(spark, write(text))
    assert [r.k for r in order.children(rows).collect()] == ["a"]
    assert profile.count_tags(markup.elements(rows)).where("name = 'tag'").first().n == 2


def generated(seed: int, count: int) -> tuple[str, dict]:
    """Random markup and what it holds, computed here in plain Python."""
    rng = random.Random(seed)
    out, kids, tops = [], [], []
    for i in range(count):
        kind = rng.choice(TOP_LEVEL)
        tops.append((kind, str(i)))
        children, refs = [], 0
        for j in range(rng.choice([0, 0, 1, 2, 3, rng.randint(4, 60)])):
            if kind == "way" and rng.random() < 0.7:
                children.append(fx.nd(j))
                kids.append(("nd", kind, str(i), None, str(j), refs))
                refs += 1
            else:
                children.append(fx.tag(f"k{j}", f"a > b ü {j}"))
                kids.append(("tag", kind, str(i), f"k{j}", None, None))
        out.append({"node": fx.node, "way": fx.way, "relation": fx.relation}[kind](i, children=children))
    return fx.document(*out), {"kids": kids, "tops": tops}


@pytest.mark.parametrize("split, bits", [("64k", 12), ("16k", 3), ("4k", 5), ("128m", 0), ("2k", 12)])
def test_split_invariance(spark, write, split, bits):
    text, truth = generated(7, 1500)
    path = write(text)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, split)
    try:
        rows = markup.events(spark, path)
        staged = markup.stage_events(spark, path, path + ".staged")
        blocks = staged.select("block").distinct().count()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert blocks > 1 or split == "128m"
    assert staged.count() == rows.count()
    kids = order.children(staged, bits).orderBy(*markup.POSITION)
    assert collected(kids.select("name", "parent.name", "parent.id", "k", "ref", "position")) == truth["kids"]
    index = order.element_index(staged, bits).orderBy("element")
    assert [(r.name, r.id, r.element) for r in index.collect()] == [
        (n, i, e) for e, (n, i) in enumerate(truth["tops"])
    ]
    kth = order.every_kth(staged, 7, bits).orderBy("element")
    assert [r.id for r in kth.collect()] == [i for _, i in truth["tops"][::7]]


def test_one_element_over_many_splits(spark, write):
    """A third of all rows under one path: its refs are spread over splits and segments."""
    text = fx.document(
        *[fx.node(i, children=[fx.tag("a", "b")]) for i in range(500)],
        fx.way(1, children=[fx.nd(i) for i in range(3000)]),
        *[fx.way(2 + i, children=[fx.nd(i), fx.nd(i)]) for i in range(500)],
    )
    path = write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        staged = markup.stage_events(spark, path, path + ".staged")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    refs = shape.way_node_positions(order.children(staged, 4))
    hot = refs.where("id = '1'")
    assert sorted(collected(hot.select(F.col("node_id").cast("int"), "position"))) == [(i, i) for i in range(3000)]
    assert refs.where("id <> '1' AND position > 1").count() == 0


@pytest.mark.parametrize("codec", ["gz", "bz2"])
def test_compressed_extract(spark, tmp_path, codec):
    import bz2
    import gzip

    text, truth = generated(5, 400)
    target = tmp_path / f"map.xml.{codec}"
    target.write_bytes({"gz": gzip, "bz2": bz2}[codec].compress(text.encode()))
    kids = order.children(markup.events(spark, str(target)), 4).orderBy(*markup.POSITION)
    assert collected(kids.select("name", "parent.name", "parent.id", "k", "ref", "position")) == truth["kids"]


def test_several_files_are_one_extract(spark, tmp_path):
    (tmp_path / "part-0").write_text("<map>" + fx.way(1, children=[fx.nd(1), fx.nd(2)])[:-len("</way>")])
    (tmp_path / "part-1").write_text(fx.nd(3) + "</way>" + fx.way(2, children=[fx.nd(4)]) + "</map>")
    rows = markup.events(spark, str(tmp_path))
    assert sorted(collected(shape.way_node_positions(order.children(rows)))) == [
        ("1", "1", 0), ("1", "2", 1), ("1", "3", 2), ("2", "4", 0),
    ]


def refs_of(spark, paths):
    rows = shape.way_node_positions(order.children(markup.events(spark, paths)))
    return sorted((i, int(n), p) for i, n, p in collected(rows))


def in_pieces(folder, *names):
    """A path with five refs cut into pieces, in the order of ``names``."""
    whole = "<map>" + fx.way(1, children=[fx.nd(i) for i in range(10)]) + "</map>"
    tags = whole.replace("<", "\0<").split("\0")[1:]
    per = -(-len(tags) // len(names))
    for k, name in enumerate(names):
        (folder / name).write_text("".join(tags[k * per : (k + 1) * per]))


@pytest.mark.parametrize("names", [
    ("part-99998", "part-99999", "part-100000", "part-100001"),
    ("a b.xml", "a!c.xml"),
    ("1.xml", "2.xml", "10.xml"),
    ("é9.xml", "é10.xml"),
])
def test_files_go_by_name_and_number(spark, tmp_path, names):
    in_pieces(tmp_path, *names)
    assert refs_of(spark, str(tmp_path)) == [("1", i, i) for i in range(10)]


def test_paths_go_in_the_order_given(spark, tmp_path):
    in_pieces(tmp_path, "b.xml", "a.xml")
    given = [str(tmp_path / n) for n in ("b.xml", "a.xml")]
    assert refs_of(spark, given) == [("1", i, i) for i in range(10)]
    with pytest.raises(ValueError, match="bad nesting"):
        refs_of(spark, given[::-1])
    with pytest.raises(ValueError, match="twice"):
        refs_of(spark, [given[0], given[0]])


BROKEN = [
    '<node id="1"><tag k="a" v="b"/></way><tag k="c" v="d"/></node>',
    '<node id="1"><way id="2"><nd ref="1"/></way><tag k="c" v="d"/></node>',
    '<node id="1"><way id="2"/><tag k="c" v="d"/></node>',
    '<node id="1"><tag k="a" v="b"/>',
    '<node id="1"/></way>',
    '<way id="2"><nd ref="1"/>',
    '<node id="1"/><tag k="a" v="b"/></node>',
    '<node id="1"><tag k="a" v="b"></nd></node>',
    '<node id="1"><tag k="a" v="b"></node>',
    '<way id="1"><a><b></a></b></way>',
    '<node id="1"/></map><map>' + "<a>" * 40 + "</a>" * 41,
]


@pytest.mark.parametrize("text", BROKEN)
def test_bad_nesting_stops_the_scan(spark, write, text):
    with pytest.raises(ValueError, match="bad nesting"):
        markup.events(spark, write(f"<map>{text}</map>"))


@pytest.mark.parametrize("text", [BROKEN[2], "</map>", BROKEN[7], BROKEN[8]])
def test_bad_nesting_stops_the_whole_chain(spark, write, tmp_path, text):
    whole = "<map>" if text == "</map>" else f"<map>{text}</map>"
    with pytest.raises(ValueError, match="bad nesting"):
        wrangle(spark, write(whole), str(tmp_path / "out"))


@pytest.mark.parametrize("bits", [0, 1, 2, 16])
def test_nesting_does_not_depend_on_segments(spark, bits):
    """Random tags cut at every place give what a stack gives."""
    rng = random.Random(bits)
    names = ["map", "node", "way", "tag", "x"]

    def verdict(tags):
        stack = []
        for event, name in tags:
            if event != "close" and name in TOP_LEVEL and any(n in TOP_LEVEL for n in stack):
                return False
            if event == "open":
                stack.append(name)
            elif event == "close" and (not stack or stack.pop() != name):
                return False
        return not stack

    for i in range(25):
        tags, stack = [], []
        while len(tags) < 14 or stack:
            if len(tags) < 14 and rng.random() < 0.55:
                stack.append(rng.choice([n for n in names if n not in TOP_LEVEL or not set(stack) & set(TOP_LEVEL)]))
                tags.append(("open", stack[-1]))
            elif stack:
                tags.append(("close", stack.pop()))
            if rng.random() < 0.2 and not set(stack) & set(TOP_LEVEL):
                tags.append(("empty", "node"))
        if i % 2:
            tags[rng.randrange(len(tags))] = (rng.choice(["open", "close", "empty"]), rng.choice(names))
        rows = spark.createDataFrame(
            [(k % 7 // 3, k // 7, k, e, n) for k, (e, n) in enumerate(tags)], "file INT, block LONG, seq LONG, event STRING, name STRING"
        ).withColumns({"block": F.expr("seq div 3"), "file": F.expr("cast(seq div 6 as int)")})
        try:
            nesting.check(rows, bits)
            fits = True
        except ValueError:
            fits = False
        assert fits == verdict(tags), tags


def test_bad_nesting_across_splits(spark, tmp_path):
    (tmp_path / "1.xml").write_text('<map><node id="1"><tag k="a" v="b"/>')
    (tmp_path / "2.xml").write_text('<tag k="a" v="c"/>')
    (tmp_path / "3.xml").write_text("</node></map>")
    rows = markup.events(spark, str(tmp_path))
    assert [r.v for r in order.children(rows).orderBy(*markup.POSITION).collect()] == ["b", "c"]
    (tmp_path / "3.xml").write_text("</way></map>")
    with pytest.raises(ValueError, match="bad nesting: </way> does not close <node>"):
        markup.events(spark, str(tmp_path))


COMMENTED = (
    '<?xml version="1.0"?>\n<!-- <node id="0"><tag k="a&b" v=1> <-- --><map>',
    fx.way(1, children=[fx.nd(5), "<!-- <nd ref='6'/> <!-- </way> <![CDATA[ -->", fx.nd(7), "<![CDATA[ <nd ref='8'/> --> ]]>", fx.nd(9)]),
    '<!----><!--><node id="3"/>--><?sort <node id="4"/> -->?>' + fx.node(2, children=[fx.tag("a --&gt;", "b --> ?> ]]>")]),
    '<!-- a > b --></map><!-- </map> -->',
)
PLAIN = (
    "<map>", fx.way(1, children=[fx.nd(5), fx.nd(7), fx.nd(9)]), fx.node(2, children=[fx.tag("a --&gt;", "b --> ?> ]]>")]), "</map>",
)


def seen(rows):
    kids = order.children(rows, 2).orderBy(*markup.POSITION).select("name", "parent.name", "parent.id", "k", "v", "ref", "position")
    return collected(rows.orderBy(*markup.POSITION).select("event", "name", *markup.ATTRIBUTES)), collected(kids)


def test_commented_markup_is_skipped(spark, write):
    assert seen(markup.events(spark, write("\n".join(COMMENTED)))) == seen(markup.events(spark, write("\n".join(PLAIN), "plain.xml")))


@pytest.mark.parametrize("every", [1, 2, 5])
def test_comments_cut_by_files(spark, tmp_path, every):
    """Files cut between any two rows of the scan, inside comments too."""
    pieces = "\n".join(COMMENTED).replace("<", "\0<").split("\0")[1:]
    for i in range(0, len(pieces), every):
        (tmp_path / f"{i}.xml").write_text("".join(pieces[i : i + every]))
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.xml").write_text("\n".join(PLAIN))
    cut = [str(tmp_path / f"{i}.xml") for i in range(0, len(pieces), every)]
    assert seen(markup.events(spark, cut)) == seen(markup.events(spark, str(tmp_path / "plain")))


@pytest.mark.parametrize("sent", [1 << 18, 0])
@pytest.mark.parametrize("split", ["16k", "128m"])
def test_hidden_rows_are_filtered_without_a_sort(spark, write, tmp_path, monkeypatch, split, sent):
    """Comments over many words, segments and splits, and many short ones; bits are sent to all tasks, or rows are shuffled."""
    rng = random.Random(3)
    parts, plain = [], []
    for i in range(400):
        element = fx.way(i, children=[fx.nd(i), fx.tag("a", "b")]) if i % 2 else fx.node(i)
        parts.append(element)
        plain.append(element)
        count = 9000 if i in (100, 250) else rng.choice([0, 0, 1, 2, 63, 64, 65])
        inside = "".join(rng.choice(['<nd ref="1"/>', "</way>", "<node id=x>"]) for _ in range(count))
        parts.append(rng.choice(["<!--{}-->", "<![CDATA[{}]]>", "<?p {}?>"]).format(inside))
    monkeypatch.setattr(lexical, "MAX_SENT", sent)
    stored = []
    real = markup.store
    monkeypatch.setattr(markup, "store", lambda rows, target, *layout: stored.append((target, rows, layout)) or real(rows, target, *layout))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", split)
    try:
        rows = markup.stage_events(spark, write(fx.document(*parts)), str(tmp_path / "staged"))
        target, kept, layout = stored[-1]
        text = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert target.endswith("-outside") and not layout
    assert "Window" not in text and "Sort" not in text and text.count("Exchange hashpartitioning") == (0 if sent else 2)
    assert not (tmp_path / "staged").exists() and not (tmp_path / "staged-hidden").exists()
    assert seen(rows) == seen(markup.events(spark, write(fx.document(*plain), "plain.xml")))


def test_children_without_their_attributes(spark, write):
    rows = markup.events(spark, write(fx.document(fx.way(1, children=[fx.nd(5), fx.tag("a", "b"), fx.nd(6)]))))
    kids = order.children(rows, fields=("ref",))
    assert kids.columns == [*markup.POSITION, "name", "ref", "parent", "position"]
    assert collected(kids.orderBy("seq").select("name", "ref", "parent.id", "position")) == [("nd", "5", "1", 0), ("tag", None, "1", None), ("nd", "6", "1", 1)]


@pytest.mark.parametrize("text", ["<map/><!-- <node/>", "<map><![CDATA[ <a> </map>", "<map/><?p <a/>"])
def test_what_is_open_at_the_end_stops_the_scan(spark, write, text):
    with pytest.raises(ValueError, match="open at the end"):
        markup.events(spark, write(text))


@pytest.mark.parametrize("declared, codec", [
    ("ISO-8859-1", "latin-1"), ("latin1", "latin-1"), ("UTF-16", "utf-16"), ("UTF-16", "utf-16-le-bom"), ("utf-16", "utf-16-be-bom"),
    ("UTF-16LE", "utf-16-le"), ("UTF-16BE", "utf-16-be"), ("US-ASCII", "ascii"), ("utf-8", "utf-8-sig"), (None, "utf-16"),
])
def test_declared_encodings_equal_their_utf_8_twin(spark, tmp_path, declared, codec):
    body = "<map>" + fx.node(1, ("Jürgen" if codec != "ascii" else "Jurgen", 7), [fx.tag("straße" if codec != "ascii" else "s", "a\nb &amp; ÿ" if codec != "ascii" else "x")]) + fx.way(2, children=[fx.nd(1)] * 50) + "</map>"
    text = (f'<?xml version="1.0" encoding="{declared}"?>' if declared else '<?xml version="1.0"?>') + body
    bom = {"utf-16-le-bom": b"\xff\xfe", "utf-16-be-bom": b"\xfe\xff"}.get(codec, b"")
    for name, data in (("a", bom + text.encode(codec.removesuffix("-bom"))), ("b", body.encode())):
        (tmp_path / f"{name}.xml").write_bytes(data)
    got, twin = (seen(markup.events(spark, str(tmp_path / f"{n}.xml"))) for n in "ab")
    assert got == twin


def test_files_of_several_encodings_are_one_extract(spark, tmp_path):
    (tmp_path / "1.xml").write_bytes('<?xml version="1.0" encoding="ISO-8859-1"?><map>'.encode() + fx.node(1, ("é", 1)).encode("latin-1") + b"</map>")
    (tmp_path / "2.xml").write_bytes(('<?xml version="1.0" encoding="UTF-16"?><map>' + fx.node(2, ("€", 1)) + "</map>").encode("utf-16"))
    (tmp_path / "3.xml").write_text("<map>" + fx.node(3, ("ß", 1)) + "</map>", encoding="utf-8")
    index = order.element_index(markup.events(spark, str(tmp_path)))
    assert sorted((r.element, r.id) for r in index.collect()) == [(0, "1"), (1, "2"), (2, "3")]
    rows = markup.elements(markup.events(spark, str(tmp_path))).where("kind = 'node'").orderBy(*markup.POSITION)
    assert [r.user for r in rows.collect()] == ["é", "€", "ß"]


@pytest.mark.parametrize("declared, data", [
    ("UTF-8", "é".encode("latin-1")), (None, "é".encode("latin-1")), ("US-ASCII", "é".encode()), ("UTF-16", b"a"), ("EBCDIC", b"a"),
])
def test_bytes_that_contradict_the_declaration_stop_the_scan(spark, tmp_path, declared, data):
    head = f'<?xml version="1.0" encoding="{declared}"?>' if declared else ""
    (tmp_path / "a.xml").write_bytes(head.encode() + b'<map><node id="1" user="' + data + b'"/></map>')
    with pytest.raises(Exception, match="bytes|declares|MALFORMED"):
        markup.events(spark, str(tmp_path)).collect()
    wide = ('<?xml version="1.0" encoding="UTF-8"?><map/>').encode("utf-16")
    (tmp_path / "a.xml").write_bytes(wide)
    with pytest.raises(ValueError, match="declares"):
        markup.events(spark, str(tmp_path))


@pytest.mark.parametrize("tag", ['tag k="a" v="\x01"', 'tag k="\x02" v="b"', 'nd ref="1\x1f"', 'node id="\x01"'])
def test_characters_that_xml_forbids_stop_the_scan(spark, write, tag):
    with pytest.raises(Exception, match="MALFORMED"):
        markup.events(spark, write(f"<map><{tag}/></map>")).collect()


def test_plain_spelling_reads_like_any_other(spark, write):
    """Refs and tags in plain form are read by a pattern, the same data spelled otherwise is parsed."""
    values = ["", " ", "a b", "'", ">", "/", "/>", "k=", " v=", "é", "\\", "$1", "a" * 300]
    plain = [f'<tag k="k{v}" v="{v}"/>' for v in values] + [f'<nd ref="{v}" />' for v in values]
    other = [t.replace("<tag ", "<tag  ").replace("<nd ", "<nd\n") for t in plain]
    read = [
        collected(markup.elements(markup.events(spark, write(fx.document(*tags), name)))
                  .where("kind IN ('tag', 'nd')").orderBy("seq").select("kind", *markup.ATTRIBUTES))
        for tags, name in ((plain, "plain"), (other, "other"))
    ]
    assert read[0] == read[1]
    assert [r[9:12] for r in read[0]] == [(f"k{v}", v, None) for v in values] + [(None, None, v) for v in values]


def test_moved_splits_are_noticed(spark, write, monkeypatch):
    """Rows whose segment is not in the summary stop the job; none is given a wrong parent."""
    rows = markup.events(spark, write(fx.small()))
    real = order._carried_in
    monkeypatch.setattr(order, "_carried_in", lambda local: real(local.where("segment % 2 = 0")))
    with pytest.raises(Exception, match="splits moved|bad nesting"):
        order.children(rows, 2).collect()
    with pytest.raises(Exception, match="splits moved|bad nesting"):
        order.every_kth(rows, 10, 2).collect()
