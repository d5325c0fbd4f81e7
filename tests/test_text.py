import pytest
from pyspark.sql import functions as F

from wreath.functions import text as TX

SYN = ("plot", "synopsis", "premise", "summary", "overview", "setting", "back story", "backstory")


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first()["y"]


def test_casefold_and_ascii(spark):
    assert one(spark, TX.casefold, "Straße ÉTÉ") == "strasse été"
    assert one(spark, lambda c: TX.to_ascii(TX.casefold(c)), "Ñandú Ærø Œuvre ß") == "nandu aero oeuvre ss"


def test_name_key_tokens(spark):
    assert one(spark, TX.name_key, "The Lord of the Rings: Return of the King") == "lord rings return king"
    assert one(spark, TX.name_key, "N. K. Jemisin") == "jemisin"
    assert one(spark, TX.name_key, "") == ""


def test_headline_prefix_before_lower(spark):
    assert one(spark, lambda c: TX.clean_headline(c, F.lit("abs")), "LEAD:Big News") == "big news abs"
    assert one(spark, lambda c: TX.clean_headline(c, F.lit("abs")), "lead:Big") == "lead:big abs"
    assert one(spark, lambda c: TX.clean_headline(c, F.lit(None).cast("string")), "X") is None


def test_article_name_keeps_plus(spark):
    url = "https://en.wikipedia.org/wiki/Flowers_for_Algernon%3A_A+B"
    assert one(spark, TX.article_name, url) == "Flowers_for_Algernon:_A+B"


def test_str_after(spark):
    m = "http://www.wikidata.org/entity/"
    assert one(spark, lambda c: TX.str_after(c, m), m + "Q42") == "Q42"
    assert one(spark, lambda c: TX.str_after(c, m), "urn:x") == ""


def test_strip_and_split(spark):
    assert one(spark, TX.strip_ws, "\n\t  a b \n") == "a b"
    assert one(spark, lambda c: TX.split_part(c, ";", 2), "title;author") == "author"


def test_any_prefix(spark):
    df = spark.createDataFrame([("Plot summary",), ("Reception",), ("BACKSTORY",), ("Settings",)], "h string")
    got = [r.h for r in df.filter(TX.any_prefix(F.col("h"), SYN)).collect()]
    assert got == ["Plot summary", "BACKSTORY", "Settings"]


HTML = ('<div><script>var t="</p>";</script><p>First <b>bold</b> &amp; more'
        '<span class="error">Cite error</span></p><p>Second<br><p>Third &lt;x&gt;</p></div>')


def test_paragraph_text(spark):
    assert one(spark, TX.paragraph_text, HTML) == "First bold & more\nSecond\nThird <x>"


def test_synopsis_sections(spark):
    page = ('<p>Intro text.</p><h2 id="a">Reception</h2><p>Loved.</p>'
            '<h2 id="b">Plot summary</h2><p>Things happen.</p><p>More.</p><h2>Plot again</h2><p>No.</p>')
    assert one(spark, lambda c: TX.synopsis(c, SYN), page) == "Things happen.\nMore."
    no_plot = '<p>Intro text.</p><h2>Reception</h2><p>Loved.</p>'
    assert one(spark, lambda c: TX.synopsis(c, SYN), no_plot) == "Intro text."
    empty_plot = '<p>Intro.</p><h2>Plot</h2><div>no paragraphs</div>'
    assert one(spark, lambda c: TX.synopsis(c, SYN), empty_plot) is None


def test_fold_ascii_equals_casefold_then_ascii(spark):
    texts = ["Straße ÆØÅ œuvre ſ Đakovo Łódź ÞÓR ﬁne ẞ", "Çà et là, ÉTÉ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = df.select(TX.fold_ascii(F.col("x")).alias("a"),
                     TX.to_ascii(TX.casefold(F.col("x"))).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_markup_shapes():
    from wreath.functions.markup import page_text, section_text

    for page, want in [
        ('<p><span class="error">E<span>1<span>2<span>3</span></span></span> tail</span>x</p>', "x"),
        ('<p title="a>b">txt</p>', "txt"),
        ("<p>a &amp b &colon; &nosuch; &#x1F600;</p>", "a & b : &nosuch; \U0001F600"),
        ("<p>one<p>two", "one\ntwo"),
        ("<div><p>in</div>out<p>next</p>", "in\nnext"),
        ("<p>1 < 2 <b>and</b> 3 > 2<br>x<img alt='<p>'>y</p></p>z", "1 < 2 and 3 > 2xy"),
        ("<p>a<!-- <p>no</p> -->b<script>if (a<b) '<p>'</script>c<style>p{}</style></p>", "abc"),
        ("<p><span class='x error y'>no</span><span class=errors>yes</span></p>", "yes"),
        ('<p><span class="error">never closed</p><p>after</p>', "\nafter"),
        ("<p>unclosed <b", "unclosed <b"), ("", ""), ("<p></p>", ""), ("plain", "")]:
        assert page_text(page) == want, page
    assert page_text("<p>" + "<b>x</b>" * 20_000 + '<a title="' + "y" * 100_000) == "x" * 20_000 + '<a title="' + "y" * 100_000
    assert section_text("<p>i</p><h3>PLOT &amp; more</h3><p>a</p><h4>Part</h4><p>b</p><h2>Next</h2><p>c</p>", ["plot"]) == "a\nb"


@pytest.mark.parametrize("text, want", [
    ("한강", "hangang"), ("이", "i"), ("村上春樹", "cun shang chun shu"), ("カズオ イシグロ", "kazuo ishiguro"), ("نجيب محفوظ", "njyb mhfwz"),
    ("“It’s” – so…", "\"It's\" - so..."), ("חיים", "hyym"), ("Достоевский", "Dostoevskii"), ("٣", "3"), ("plain", "plain"), ("", ""), (None, None)])
def test_other_scripts(spark, text, want):
    got = one(spark, TX.to_ascii, text)
    assert got == want or got is not None and got.strip() == want


def test_names_of_other_scripts_have_keys(spark):
    assert one(spark, TX.name_key, "한강") == "hangang"
    assert one(spark, TX.name_key, "村上春樹") == "cun shang chun shu"
