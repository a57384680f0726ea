import collections
import itertools
import random
import re
import unicodedata
from html.parser import HTMLParser

from pyspark.sql import functions as F

from folioflow.functions import segmentation as seg
from folioflow.functions import text as t
from folioflow.sources import shredding as sh


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("v")).first()["v"]


def boundary_cases():
    """Pairs of clauses joined in every way that a rule of the segmenter speaks of, with the number of sentences."""
    heads, tails = ["sand settles", "(as rivers do) silt drifts"], ["Clay stays", "Peat burns"]
    for h, t in itertools.product(heads, tails):
        for mark, close in itertools.product(".!?", ["", '"', ")", "”"]):
            yield f"{h}{mark}{close} {t}.", 2
            yield f"{h}{mark}{close} {t.lower()}.", 1
        for title in seg.TITLES:
            yield f"{h} near {title.capitalize()}. {t}.", 1
        for word in seg.ARGUMENTS:
            yield f"{h} in {word}. 4 {t}.", 1
            yield f"{h} in {word}. (4) {t}.", 1
            yield f"{h} in {word}. {t}.", 1 if len(word) == 1 else 2  # a single letter never ends a sentence
        for word in (w.replace("\\", "") for w in seg.PHRASES):
            yield f"{h} {word}. 4 {t}.", 1
            yield f"{h} {word}. {t.lower()}.", 1
            yield f"{h} {word}. {t}.", 2
        for letter in "QZ":
            yield f"{h} by {letter}. {t}.", 1
        yield f"{h} at 7.5 metres. {t}.", 2
        yield f"{h} (it is so. {t}) always. {t}.", 2
        yield f"{h} [[CITE:c1]]. {t}.", 2
        yield f"{h}. [[CITE:c1]] {t}.", 2
        for private in (seg.MARK, seg.MASK):
            yield f"{h}. {private}{t}. {t}.", 2
            yield f"{h} {private} {t}. {t}.", 2


def test_sentence_counts_by_rule(spark):
    cases = list(boundary_cases())
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "k long, text string")
    rows = seg.sentences(df, ["k"]).orderBy("k", "sent_no").collect()
    got = collections.defaultdict(list)
    for r in rows:
        got[r["k"]].append(r)
    for i, (s, n) in enumerate(cases):
        assert (s, len(got[i])) == (s, n)
        assert [r["sent_no"] for r in got[i]] == list(range(1, n + 1)) and all(s[r["char_start"] : r["char_end"]] == r["text"] for r in got[i])


def test_tokens_stay_with_their_sentence_and_offsets_hold(spark):
    s = "Rivers carry sand [[CITE:c1]]. Lakes keep it."
    r = seg.sentences(spark.createDataFrame([(1, s)], "k long, text string"), ["k"]).orderBy("sent_no").collect()
    assert [x["citation_ids"] for x in r] == [["c1"], []]
    assert [s[x["char_start"] : x["char_end"]] for x in r] == [x["text"] for x in r]


def test_identifiers(spark):
    for head in ["https://doi.org/", "http://dx.doi.org/", "doi:", "DOI:  ", " "]:
        for tail in ["", "..."]:
            assert one(spark, t.normalise_doi(F.col("x")), x=f"{head}10.9999/Ab.C-{len(head)}{tail}") == f"10.9999/ab.c-{len(head)}"
    assert one(spark, t.normalise_doi(F.col("x")), x="11.1/x") is None
    ids = {"2301.00001": "2301.00001", "2301.00001v12": "2301.00001", "ARXIV:2301.00001": "2301.00001", "cs.LG/0101001": "cs.LG/0101001", "quant-ph/9912345": "quant-ph/9912345", "2301.1": None, "10.9999/x": None, " ": None}
    for s, want in ids.items():
        assert one(spark, t.normalise_arxiv(F.col("x")), x=s) == want


def test_text(spark):
    assert one(spark, t.normalize_text(F.col("x")), x="\tsand \n\n and  clay ") == "sand and clay"
    pair = t.jaccard(t.title_tokens(F.col("x")), t.title_tokens(F.col("y")))
    assert one(spark, pair, x="The Grain of the Sand", y="a grain of sand!") == 1.0
    assert one(spark, pair, x="grain size", y="grain shape") == 1 / 3
    assert one(spark, pair, x="of the", y="sand") == 0.0
    assert sorted(one(spark, t.title_tokens(F.col("x")), x="Größe über Null")) == sorted(["gro", "sse", "u", "ber", "null"])
    assert one(spark, t.filter_safe(F.col("x")), x="sand, clay: (or) silt?") == "sand clay or silt"
    assert one(spark, t.locator_suffix(F.col("x"), F.lit("chapter"), F.lit("my italics")), x="3") == ", chap. 3, my italics"


def test_unicode_forms_meet(spark):
    df = spark.createDataFrame([(1, "é"), (2, "é"), (3, "plain"), (4, None)], "k long, x string")
    got = {r["k"]: r["x"] for r in t.compose(df, "x").collect()}
    assert got[1] == got[2] and got[3] == "plain" and got[4] is None


def test_provider_records(spark):
    a = '{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1/A","display_name":"T","publication_year":2019,"type":"book-chapter","biblio":{"first_page":"1","last_page":"9"},"locations":[{"landing_page_url":"http://arxiv.org/abs/1706.03762v2"}],"authorships":[{"author":{"display_name":"Ann"}}],"abstract_inverted_index":{"b":[1],"a":[0,2]}}'
    r = sh.works_from_openalex(spark.createDataFrame([(a,)], "json string")).first()
    assert (r["external_id"], r["doi"], r["arxiv_id"], r["title"], r["pages"], r["work_type"], r["abstract"], r["authors"]) == ("W1", "10.1/a", "1706.03762", "T", "1-9", "chapter", "a b a", ["Ann"])
    b = '{"paperId":"p","externalIds":{"DOI":"10.1/B"},"title":"U","venue":"","year":2020,"authors":[{"name":"Bo"}],"publicationTypes":["Unknown","Conference"]}'
    r = sh.works_from_s2(spark.createDataFrame([(b,)], "json string")).first()
    assert (r["external_id"], r["doi"], r["venue"], r["work_type"]) == ("p", "10.1/b", None, "paper-conference")


def test_binary_manifest(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no")
    r = {x["path"][-5:]: x["verdict"] for x in sh.binary_manifest(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert r == {"a.pdf": "ACCEPTED", "b.pdf": "NOT_A_PDF"}


def test_sinks(spark, tmp_path):
    refs = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "paper_id long, bibliography_order long, title string")
    sh.write_json_bibliography(refs, str(tmp_path / "j"))
    assert [x["title"] for x in spark.read.json(str(tmp_path / "j")).first()["references"]] == ["a", "b"]
    for _ in range(2):
        sh.append_attempts(refs, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_unicode_forms_hash_alike(spark):
    texts = ["plain  text", "caf\u00e9 \n au lait", "\u212bngstr\u00f6m", "\u1ec7 \u0390", "\ud55c\uae00", "", None]
    rows = [(i, form, x if x is None else unicodedata.normalize(form, x)) for i, x in enumerate(texts) for form in ("NFC", "NFD")]
    d = spark.createDataFrame(rows, "i int, form string, x string")
    d = d.select("i", "x", t.text_sha256(F.col("x")).alias("h"), t.canonical_sha256({"k": F.col("x")}, ("k",)).alias("c"), t.normalize_text(t.composed(F.col("x"))).alias("n"))
    got = {}
    for r in d.collect():
        assert r["n"] == (None if r["x"] is None else " ".join(unicodedata.normalize("NFC", r["x"]).split()))
        got.setdefault(r["i"], set()).add((r["h"], r["c"]))
    assert all(len(v) == 1 for v in got.values())


def test_names_fold_as_unicode_says(spark):
    names = [" M\u00fcller ", "MU\u0308LLER", "Stra\u00dfe", "\u0130nan", "\u0141ukasz", "\u010capek", "\ufb01sher", "\u039f\u03b4\u03c5\u03c3\u03c3\u03b5\u03cd\u03c2", "\u0416\u0443\u043a", "SMITH", "", None]
    d = spark.createDataFrame([(x,) for x in names], "x string")

    def fold(x):
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold().strip()

    assert [r["f"] for r in d.select(t.fold_name(F.col("x")).alias("f")).collect()] == [fold(x) for x in names]


class Outline(HTMLParser):
    """A plain reading of S07's rules: sections with level, title and paragraphs."""

    def __init__(self):
        super().__init__()
        self.stack, self.found, self.into = [], [], None

    def open(self, rank, box):
        self.found.append({"level": len(self.stack) + 1, "title": None, "texts": []})
        self.stack.append((len(self.found) - 1, rank, box))

    def handle_starttag(self, tag, attrs):
        if re.fullmatch(sh.BLOCKS, tag):
            self.into = None
        if tag in ("section", "article"):
            self.open(0, True)
        elif re.fullmatch("h[1-6]", tag):
            rank = int(tag[1])
            if not (self.stack and self.stack[-1][2] and self.found[self.stack[-1][0]]["title"] is None):
                while self.stack and not self.stack[-1][2] and self.stack[-1][1] >= rank:
                    self.stack.pop()
                self.open(rank, False)
            self.found[self.stack[-1][0]]["title"] = ""
            self.into = (self.stack[-1][0], None)
        elif tag == "p" and self.stack:
            texts = self.found[self.stack[-1][0]]["texts"]
            texts.append("")
            self.into = (self.stack[-1][0], len(texts) - 1)

    def handle_endtag(self, tag):
        if re.fullmatch(sh.BLOCKS, tag):
            self.into = None
        if tag in ("section", "article") and any(box for _, _, box in self.stack):
            while not self.stack.pop()[2]:
                pass

    def handle_data(self, data):
        if self.into and self.cdata_elem is None:
            section, no = self.into
            if no is None:
                self.found[section]["title"] += data
            else:
                self.found[section]["texts"][no] += data


def markup(rng):
    """Nested elements with headings of any rank, closed or open paragraphs, stray ends, scripts and comments."""
    out, boxes = [], 0
    for i in range(rng.randrange(30)):
        kind = rng.randrange(9)
        if kind < 2:
            out.append(rng.choice(["<section>", '<article class="a">', "<SECTION\n>"]))
        elif kind == 2:
            out.append(rng.choice(["</section>", "</article>"]))
        elif kind < 5:
            n = rng.randrange(1, 7)
            out.append(f"<h{n}>{rng.choice(['', 'Head <i>' + str(i) + '</i>'])}</h{n}>")
        elif kind < 8:
            out.append(f"<p>text {i} <b>x</b>" + rng.choice(["</p>", ""]))
        else:
            out.append(rng.choice(["<script>var a='<p>';</script>", "<!-- <h1>no</h1> -->", "<div>aside</div>", "loose"]))
    return "".join(out)


def test_sections_equal_a_plain_parser(spark):
    rng = random.Random(3)
    pages = [(i, markup(rng)) for i in range(150)] + [(900, None), (901, ""), (902, "<p>only")]
    got = {}
    for r in sh.sections(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html").collect():
        got.setdefault(r["page_id"], set()).add((r["section_no"], r["level"], r["title"], r["paragraph_no"], r["text"]))
    for page, html in pages:
        o = Outline()
        o.feed(html or "")
        o.close()
        want = set()
        for n, s in enumerate(o.found, 1):
            title = " ".join((s["title"] or "").split()) or f"Section {n}"
            texts = [(k, " ".join(x.split())) for k, x in enumerate(s["texts"], 1)] or [(None, None)]
            want |= {(n, s["level"], title, k, x) for k, x in texts}
        assert got.get(page, set()) == want, html


def test_guards_by_class(spark):
    rows = [(w, after, kind) for words, after, kind in ((seg.TITLES, "X", "TITLE"), (["A", "q"], "X", "INITIAL"), (seg.ARGUMENTS, "(", "ARGUMENT"), (seg.PHRASES, "9", "PHRASE")) for w in (x.replace("\\", "") for x in words) if len(w) > 1 or kind == "INITIAL"]
    rows += [("figs", "X", "NONE"), ("etc", "X", "NONE"), ("sofa", "9", "NONE"), ("x.p", "9", "NONE"), ("(Fig", "[", "ARGUMENT")]
    d = spark.createDataFrame(rows, "a string, b string, kind string").select("*", seg.abbreviation_guard(F.col("a"), F.col("b")).alias("got"))
    assert [r for r in d.collect() if r["got"] != r["kind"]] == []
