import unicodedata

import regex
from pyspark.sql import functions as F

from docloom.functions import html as H
from docloom.functions import text as T


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("r")).first().r


def test_tokens(spark):
    assert one(spark, T.legal_tokens(F.col("c")), "Điều 7, Khoản 2: quy định rõ.") == ["điều", "7", "khoản", "2", "quy", "định", "rõ"]
    assert one(spark, T.number_tokens(F.col("c")), "Theo 73/2016/NĐ-CP a 5") == ["theo", "73/2016/nđ-cp", "5"]
    assert one(spark, T.legal_tokens(F.col("c")), unicodedata.normalize("NFD", "Điều kiện vay vốn")) == ["điều", "kiện", "vay", "vốn"]
    assert one(spark, T.legal_tokens(F.col("c")), "STRASSE straße İz x_y ٣٤a") == ["strasse", "strasse", "i", "z", "x", "y", "٣٤", "a"]
    assert one(spark, T.legal_tokens(F.col("c")), None) is None
    assert one(spark, T.plain_tokens(F.col("c")), " A  b\n") == ["A", "b"]


def test_cleaning(spark):
    assert one(spark, T.collapse(F.col("c")), " a \t\n b c ") == "a b c"
    assert one(spark, T.tidy_lines(F.col("c")), "a  b\n \n\nc ") == "a b\nc"
    assert one(spark, T.dedup_key(F.col("c")), " What?  Is, it! ") == "what is it"
    assert one(spark, T.dedup_key(F.col("c")), unicodedata.normalize("NFD", "Điều kiện  STRASSE?")) == one(spark, T.dedup_key(F.col("c")), "điều KIỆN straße") == "điều kiện strasse"
    for mark in ("", " ", "nan", "None", "Chưa phân loại"):
        assert one(spark, T.clean_null(F.col("c")), mark) is None
    assert one(spark, T.nfc(F.col("c")), "é") == "é"


def test_references(spark):
    assert one(spark, T.references(F.col("c")), "Theo điều 5 và Khoản II, năm 2016, điều 5") == ["điều 5", "Khoản II", "2016"]
    allowed = lambda a, b: one(spark, T.references_allowed(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>")))
    assert allowed(["Điều 5"], ["điều 5", "x"]) and not allowed(["Điều 6"], ["điều 5"]) and allowed([], ["x"]) and allowed(["x"], [])


def test_matches_and_triggers(spark):
    t = "Luật thay thế 73/2016/NĐ-CP và 5/VBHN-BTC."
    found = one(spark, T.matches(F.col("c"), T.DOCUMENT_NUMBER), t)
    assert [t[m.start : m.end] for m in found] == [m.word for m in found] == ["73/2016/NĐ-CP", "5/VBHN-BTC"]
    assert one(spark, T.trigger(F.col("c")), "Bãi bỏ và thay thế") == "Bãi bỏ"
    assert one(spark, T.trigger(F.col("c")), "xem") == "Trích dẫn"
    assert one(spark, T.evidence(F.col("c"), F.lit(2), F.lit(4), 1, 1), "abcdefg") == "bcde"


def test_names(spark):
    name = lambda n, k: one(spark, T.canonical_name(F.col("c"), F.lit(k)), n)
    assert name("nhnn", "CoQuan") == name("Thống đốc Ngân hàng Nhà nước", "CoQuan") == "Ngân hàng Nhà nước Việt Nam"
    assert name("tín DỤNG ngân hàng", "LinhVuc") == "Tín Dụng Ngân Hàng"
    assert name("  Ông  A ", "NguoiKy") == "Ông A"
    assert one(spark, T.relation_type(F.col("c")), "sửa đổi-1") == "SỬA_ĐỔI_1"
    assert one(spark, T.relation_type(F.col("c")), "1x") is None
    assert one(spark, T.slug(F.col("c")), "A b/C!") == "a-b-c"
    assert one(spark, T.file_name(F.col("c")), "a/b: c") == "a_b_c"


def test_natural_order(spark):
    rows = spark.createDataFrame([("src:10",), ("src:2",), ("src:1",), ("Src:3",)], "c string")
    assert [r.c for r in rows.orderBy(T.natural_key(F.col("c"))).collect()] == ["src:1", "src:2", "Src:3", "src:10"]


def test_labels_links_json(spark):
    assert one(spark, T.labels(F.col("c")), "x [E 2] y [E1] [E 2] [P 3]") == [2, 1]
    assert one(spark, T.wikilinks(F.col("c")), "[[a|b]] [[ c ]] [d]") == ["a", "c"]
    assert one(spark, F.try_variant_get(T.json_part(F.col("c")), "$.a", "int"), 'so: ```json\n{"a": 5}\n```') == 5
    assert one(spark, T.json_part(F.col("c")), "no json") is None
    assert one(spark, T.redact(F.create_map(F.lit("API_Key"), F.lit("s"), F.lit("x"), F.lit("y")))) == {"API_Key": "***", "x": "y"}
    assert one(spark, T.citation(F.lit("t"), F.lit("nan"), F.lit(None).cast("string"), F.lit("c1"))) == "t | c1"


PAGE = "<html><head><title>T &amp; t</title><style>x</style></head><body><p>one <b>two</b><br>three</p><div>four<p>five</p></div>loose<script>s</script><ul><li>six</li></ul></body></html>"


def test_html(spark):
    assert one(spark, H.html_text(F.col("c")), PAGE) == "T & t one two three four five loose six"
    assert one(spark, H.html_title(F.col("c")), PAGE) == "T & t"
    assert one(spark, H.html_title(F.col("c")), "<p><strong>S</strong></p>") == "S"
    assert one(spark, H.html_title(F.col("c")), None) == "Document"
    blocks = H.html_blocks(spark.createDataFrame([(1, PAGE), (2, None)], "page_id int, html string")).orderBy("place").collect()
    assert [(b.tag, b.text) for b in blocks] == [("p", "one two three"), ("div", "four five"), ("ul", "six")]


def test_words_of_latin_texts_are_those_of_the_pattern():
    """Every pair of Latin-1 characters beside letters, digits and each other, and what folds out of Latin-1 or into it."""
    chars = [chr(i) for i in range(256)]
    texts = [a + b for a in chars for b in chars] + ["".join(chars), "", "ab12cd 12ab 1² ²a", "straße Œuvre ١٢a 12١ été", "ﬁn Å µ ẞ"]
    for text in texts:
        for t in (text, f"x{text}1", f"1{text}x"):
            assert T.legal_words(t) == regex.findall(T.WORD, T._folded(t))
