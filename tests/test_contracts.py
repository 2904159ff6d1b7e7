"""Fields, clauses, readers and records on small texts; every registered query against its SQL."""

from __future__ import annotations

import base64
import io
import json
import time
import zipfile
import zlib

from tests import compare
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pactum import cli
from pactum.functions import fields as X
from pactum.functions import reading
from pactum.functions import sql as named
from pactum.operators import clauses as C
from pactum.operators import enrich, records, schema, sinks
from pactum.functions import vocab as V
from pactum.plans import catalog, corpus
from pactum.sources import docx, files, html, pdf
from pactum.streaming import inbox


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    texts = ["effective as of 2024-01-05", "dated March 3rd, 2021", "made as of 5th day of June 2020", "as of 3/4/99", "on Sept 5, 2023", "dated Sept 5, 2023", 'May 1, 2020 (the "Effective Date")', ""]
    got = values(spark, texts, X.effective_date)
    assert [g.value for g in got] == ["2024-01-05", "2021-03-03", "2020-06-05", "1999-03-04", None, "Sept 5, 2023", "2020-05-01", None]
    assert [g.confidence for g in got] == [0.85, 0.85, 0.85, 0.85, 0, 0.55, 0.9, 0]


def test_scalars(spark):
    texts = ["the initial term is three (3) years", "a period of consecutive days", "forty-five (45) days' notice", "shall not automatically renew", "renew automatically", "governed by the laws of England and Wales.", "pay $1500000 now"]
    assert [v.value for v in values(spark, texts, X.term_length)][:2] == ["3 years", None]
    assert values(spark, texts, X.notice_days)[2].value == 5
    assert [v.value for v in values(spark, texts, X.auto_renew)][3:5] == [False, True]
    assert values(spark, texts, X.governing_law)[5].value == "England"
    assert values(spark, texts, X.headline_value)[6].value == "$150"
    places = ["State of Delaware", "West Virginia, USA", "Ohio", "Austria", " ", None]
    assert [v.value for v in values(spark, places, X.jurisdiction)] == ["US-DE", "US-VA", "US-OH", None, None, None]


def test_parties(spark):
    texts = ['between Acme Corp., a Delaware corporation ("Seller") and The Bolt Company d/b/a Bolts ("Buyer"), dated today', "between them and nobody", 'between Initech LLC and Initrode Ltd. ("Customer").']
    got = values(spark, texts, X.parties)
    assert [(p.name, p.role) for p in got[0]] == [("Acme Corp.", "Seller"), ("The Bolt Company", "Buyer")]
    assert got[1] == [] and [(p.name, p.role) for p in got[2]] == [("Initech LLC", None), ("Initrode Ltd", None)]


def test_signatories_and_terms(spark):
    text = "By: Ann Lee\nTitle: CEO\nName: ____\nBy:    By:\nTitle: Clerk\nName: Bob Ray\nIts: Agent\nBy: Ann Lee\n"
    assert [(s.name, s.title) for s in values(spark, [text], X.signatories)[0]] == [("Ann Lee", "CEO"), ("Bob Ray", "Agent")]
    assert [t.term for t in values(spark, ['(the "Fee") and "Work Product" (Goods) "Fee"'], X.defined_terms)[0]] == ["Fee", "Work Product", "Goods"]


def test_clauses(spark):
    caps = "INTRO 😀\n\nPAYMENT TERMS\n\nPay.\n\nTAXES\n\nNone.\n"
    repeated = "## Page\nx\n## Widget\n## Widget\n## widget.\n## Services\n"
    got = values(spark, [caps, repeated, "plain", ""], lambda t: C.clause_map(C.detected(t)))
    assert [(c.detected_title, caps[c.span.start : c.span.start + 5]) for c in got[0]] == [("PAYMENT TERMS", "PAYME"), ("TAXES", "TAXES")]
    assert [(c.canonical_title, c.mapped) for c in got[1]] == [("Suspension", True)]
    assert got[2] == [] and got[3] == []


def test_titles_and_low_signal(spark):
    rows = [("a/some_file.txt", "x" * 100), ("b.txt", "<DOC>\n\n# \n Lead line \n"), ("c.md", "text\n# Top  \n"), ("d-e.txt", None)]
    got = records.extract_text(spark.createDataFrame(rows, "path string, text string")).select("document.title", "low_signal").collect()
    assert [r.title for r in got] == ["Some File", "Lead line", "Top", "D E"] and all(r.low_signal for r in got)


def test_html():
    page = "<html><head><title>no</title></head><body><p><b>1. Fees</b></p><p>Pay &amp; go.</p><p><u>Term.</u> Two years.</p><div>x<br>y</div></body>"
    assert html.read(page) == "## Fees\n\nPay & go.\n\n## Term.\nTwo years.\n\nx\ny"
    meta = "<meta charset=utf-8><p>seen</p>"
    assert html.read(meta) == "seen" and html.read(meta, compat=True) == ""
    assert html.read("<p><b>Only</b></p><p>one</p>") == "Only\n\none"


def _docx(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(docx.PART, f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx():
    run = lambda t, b="": f"<w:r>{'<w:rPr><w:b/></w:rPr>' if b else ''}<w:t>{t}</w:t></w:r>"
    p = lambda inner, props="": f"<w:p><w:pPr>{props}</w:pPr>{inner}</w:p>"
    raw = _docx(p(run("Fees. Client pays."), '<w:pStyle w:val="Heading2"/>') + p(run("Term"), "<w:numPr/>") + p(run("Bold", "b")) + p(run("plain")) + p(""))
    assert docx.read(raw) == ("## Fees\n\nClient pays.\n\n## Term\n\n**Bold**\n\nplain\n\n", "")
    assert docx.read(b"PK junk")[0] == "" and docx.read(b"PK junk")[1]
    assert "DTD" in docx.read(_bomb())[1]


def _bomb() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(docx.PART, '<!DOCTYPE x [<!ENTITY a "a">]><x/>')
    return out.getvalue()


def _pdf(content: bytes, resources: bytes = b"<< /Font << /F1 5 0 R >> >>", extra: bytes = b"") -> bytes:
    packed = zlib.compress(content)
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources " + resources + b" >>", b"<< /Type /Page /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream", b"<< /Type /Font /Subtype /Type1 >>"]
    out, at = b"%PDF-1.4\n", []
    for i, body in enumerate(parts, 1):
        at.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % a for a in at)
    return out + b"xref\n0 6\n0000000000 65535 f \n" + table + b"trailer\n<< /Size 6 /Root 1 0 R " + extra + b">>\nstartxref\n%d\n%%%%EOF" % len(out)


def test_pdf():
    raw = _pdf(b"BT /F1 12 Tf (One \\(1\\)) Tj 0 -14 Td [(Tw) 20 (o)] TJ T* () Tj T* <546872> Tj ET")
    assert pdf.read(raw) == ("One (1)\nTwo\n\nThr", "")
    assert pdf.read(_pdf(b"q Q"))[1] == pdf.NOTES["no-text"]
    assert pdf.read(_pdf(b"BT (x) Tj ET", extra=b"/Encrypt 9 0 R "))[1] in (pdf.NOTES["encrypted"], "")
    assert pdf.read(b"%PDF junk")[1] == pdf.NOTES["structure"]
    assert pdf.unpredict(b"\x02\x01\x02\x02\x01\x01", {"Predictor": 12, "Columns": 2}) == b"\x01\x02\x02\x03"
    codes = pdf.Codes("begincodespacerange <0000> <ffff> endcodespacerange beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0003> <0042> <0005> <0006> [<0058> <0059>] endbfrange")
    assert codes(b"\0\1\0\2\0\3\0\4\0\5\0\6") == "ABCXY"


def _modern_pdf(content: bytes) -> bytes:
    """Objects in an object stream, a cross-reference stream with a predictor, content in ASCII85 over Flate."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 5: b"<< /Type /Font /Subtype /Type1 >>"}
    places, body = [], b""
    for n, text in inner.items():
        places.append(b"%d %d" % (n, len(body)))
        body += text + b" "
    head = b" ".join(places) + b" "
    packed, shown = zlib.compress(head + body), base64.a85encode(zlib.compress(content)) + b"~>"
    out, at = b"%PDF-1.5\n", {}
    for n, props, raw in ((4, b"/Filter [/ASCII85Decode /FlateDecode]", shown), (6, b"/Type /ObjStm /N 4 /First %d /Filter /FlateDecode" % len(head), packed)):
        at[n] = len(out)
        out += b"%d 0 obj\n<< /Length %d %s >>\nstream\n" % (n, len(raw), props) + raw + b"\nendstream\nendobj\n"
    at[7] = len(out)
    rows = [bytes([0, 0, 0, 255])] + [bytes([2, 0, 6, list(inner).index(n)]) if n in inner else bytes([1, *at[n].to_bytes(2, "big"), 0]) for n in range(1, 8)]
    up = b"".join(b"\x02" + bytes((x - y) & 255 for x, y in zip(r, p, strict=True)) for r, p in zip(rows, [bytes(4), *rows], strict=False))
    table = zlib.compress(up)
    return out + b"7 0 obj\n<< /Type /XRef /Size 8 /W [1 2 1] /Root 1 0 R /Length %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> >>\nstream\n" % len(table) + table + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % at[7]


def test_modern_pdf():
    assert pdf.read(_modern_pdf(b"BT /F1 9 Tf (Modern) Tj T* <54776F> Tj ET")) == ("Modern\nTwo", "")
    assert pdf.read(b"%PDF-1.4\nno structure\nstream\nBT (By the scan) Tj ET\nendstream")[0] == "By the scan"


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_predictors(kind):
    """Each row filter of PNG, written out byte by byte."""
    rows, size = [bytes(range(3, 15)), bytes([200, 7, 9, 250, 1, 0, 30, 90, 4, 4, 255, 128])], 3
    raw, before = b"", bytes(12)
    for r in rows:
        left = lambda i, x: x[i - size] if i >= size else 0
        paeth = lambda a, b, c: min((a, b, c), key=lambda v: abs(a + b - c - v))
        guess = [(0, left(i, r), before[i], (left(i, r) + before[i]) // 2, paeth(left(i, r), before[i], left(i, before)))[kind] for i in range(12)]
        raw += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(r, guess, strict=True))
        before = r
    assert pdf.unpredict(raw, {"Predictor": 10 + kind, "Columns": 4, "Colors": 3}) == b"".join(rows)


def test_files_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_bytes(b"# One\n\xff text between Alder LLC and Birch LLC.")
    (folder / "b.txt").write_text("<html><p>two</p></html>")
    (folder / "c.bin").write_bytes(_pdf(b"BT (three) Tj ET"))
    (folder / "d.docx").write_bytes(b"PK broken")
    (folder / "e.txt").write_bytes(b"\n")
    (folder / "f.md").write_bytes((folder / "a.md").read_bytes())
    got = {r.path[-4:]: r for r in files.scan(spark, str(folder)).collect()}
    assert [got[k].format for k in ("a.md", ".bin", "docx")] == ["markdown", "pdf", "docx"]
    assert "�" in got["a.md"].text and got[".bin"].text == "three"
    assert got["docx"].text == "" and "could not parse" in got["docx"].warnings[0]
    query = inbox.run(inbox.records(inbox.files(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(200)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5  # a.md and f.md are one


def test_enrichment(spark):
    base = records.extract_text(spark.createDataFrame([("a", "nothing here"), ("b", "nothing")], "path string, text string"), keep=("path", "text"))
    asked = base.select("path", enrich.prompt(F.col("text"), F.size("clauses") > 0).alias("prompt"))
    reply = '{"renewal_mechanics": " yearly ", "obligations": ["a", "", "b"], "governing_law": "Oz", "clauses": [{"title": "Fees"}, {"title": "fees."}, {"title": "nothing"}]}'

    def client(prompt: str) -> str | None:
        if "nothing here" not in prompt:
            raise OSError("down")
        return f"text {reply} text"

    answers = enrich.replies(asked, client, "path")
    merged = {r.path: r for r in enrich.merge(base.join(answers, "path")).collect()}
    a, b = merged["a"], merged["b"]
    assert (a.term.renewal_mechanics.value, [o.text for o in a.obligations], a.governing_law.value, a.jurisdiction.value) == ("yearly", ["a", "b"], "Oz", None)
    assert [(c.canonical_title, c.span.start, c.span.end) for c in a.clauses] == [("Payment", 0, 0), ("Nothing", 0, 7)]
    assert a._meta.tiers_used == ["deterministic", "llm"] and not b._meta.llm_used and b.obligations is None


def test_sinks_and_cli(spark, capsys):
    r = records.extract_text(spark.createDataFrame([("demo.md", cli.DEMO)], "path string, text string"))
    got = json.loads(r.select(sinks.json_text(r).alias("j")).first().j)
    assert got["parties"][0]["name"] == "Alder Works LLC" and got["dates"]["expiration"] == {"value": None, "confidence": 0.0, "source": "none"} and "obligations" not in got
    assert "Alder Works LLC (Client)" in sinks.table(r.first())
    texts = [json.dumps(got), json.dumps({**got, "parties": [{"name": 1}], "more": 2}), "no json", None]
    clean, broken, no_json, null = values(spark, texts, schema.faults)
    assert clean == [] and no_json == ["$: no JSON"] and null == ["$: null"]
    assert broken == ["$.parties[0].name: is no string", "$.parties[0]: lacks confidence", "$.parties[0]: lacks source", "$: has more besides"]
    assert cli.main(["fields"]) == 0 and "term.length" in capsys.readouterr().out
    assert [c["name"] for c in cli.catalog()["commands"]] == ["extract", "schema", "fields", "demo", "catalog", "completion"]


def test_schema_rules():
    rule = schema.Schema({"type": "object", "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"const": 2}, "c": {"pattern": "^x"}, "d": {"type": ["integer", "null"]}}, "additionalProperties": {"type": "boolean"}, "$defs": {"n": {"type": "number", "minimum": 0, "maximum": 1}}})
    assert rule.errors({"a": 0.5, "b": 2, "c": "xy", "d": None, "e": True}) == []
    assert rule.errors({"a": 2, "b": 3, "c": "y", "d": True, "e": 1}) == ["$.a: is too large", "$.b: isn't the value", "$.c: doesn't match", "$.d: is no integer or null", "$.e: is no boolean"]
    with pytest.raises(ValueError):
        schema.Schema({"$ref": "http://x"}).errors(1)


def test_sql_functions(spark):
    names = named.register(spark)
    assert {"extract_value", "extract_jurisdiction", "extract_title", "extract_clauses", "is_low_signal", "match_spans"} <= set(names)
    spark.createDataFrame([("pay $5 now\ngoverned by the laws of Ohio.",), (None,)], "text string").createOrReplaceTempView("texts")
    row = spark.sql("SELECT extract_value(flatten_text(text)).value AS v, extract_jurisdiction(flatten_text(text)).value AS j, is_low_signal(text) AS low FROM texts WHERE text IS NOT NULL").first()
    assert (row.v, row.j, row.low) == ("$5", "US-OH", False)
    assert [tuple(r) for r in spark.sql("SELECT start, `end`, match FROM match_spans('a1b22', '[0-9]+')").collect()] == [(1, 2, "1"), (3, 5, "22")]
    assert spark.sql(f"SELECT extract_value.value AS v FROM {named.with_fields(spark, 'texts')} WHERE text IS NOT NULL").first().v == "$5"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    good, low = tmp_path / "good.md", tmp_path / "low.txt"
    good.write_text(cli.DEMO)
    low.write_text("nothing\n")
    assert cli.main([str(good), "--fields", "parties", "--why", "--no-color"]) == 0
    said = capsys.readouterr()
    assert set(json.loads(said.out)) == {"parties", "_meta"} and "clauses=3" in said.err and "low_signal=False" in said.err
    assert cli.main(["extract", str(low), "--no-confidence"]) == 1
    said = capsys.readouterr()
    assert json.loads(said.out)["parties"] == [] and "warning" in said.err
    assert cli.main(["extract", str(low), "--silent", "--format", "table"]) == 1
    assert capsys.readouterr() == ("", "")
    assert cli.main(["extract", str(good), "--silent", "--format", "table", "--json"]) == 0 and json.loads(capsys.readouterr().out)
    assert cli.main(["extract", str(tmp_path / "none.md")]) == 2 and "error" in capsys.readouterr().err
    assert cli.main(["extract", str(tmp_path), "--out", str(tmp_path / "out")]) == 0 and spark.read.text(str(tmp_path / "out")).count() == 2
    capsys.readouterr()
    assert cli.main(["--catalog", "json"]) == 0 and "--llm" in capsys.readouterr().out
    assert cli.main(["--catalog=xml"]) == 2 and cli.main(["schema"]) == 0
    assert json.loads(capsys.readouterr().out)["properties"]["document"]["properties"]["sha256"]["pattern"] == "^[0-9a-f]{64}$"
    assert cli.main(["completion", "zsh"]) == 0 and "compdef" in capsys.readouterr().out
    assert cli.main(["__complete", "demo"]) == 0 and "--format" in capsys.readouterr().out
    assert cli.main(["demo", "--format", "table", "--silent"]) == 0 and "Alder Works LLC" in capsys.readouterr().out
    monkeypatch.setattr(cli, "_extract", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    assert cli.main(["demo"]) == 130


def test_enrichment_on_the_command_line(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "a.txt"
    path.write_text("nothing here\n")
    monkeypatch.setattr(enrich, "config", lambda: None)
    assert cli.main(["extract", str(path), "--llm"]) == 1 and "no configuration" in capsys.readouterr().err
    monkeypatch.setattr(enrich, "config", lambda: {"api_key": "k"})
    monkeypatch.setattr(enrich, "client", lambda settings: lambda prompt: '{"governing_law": "Oz", "obligations": ["pay"]}')
    assert cli.main(["extract", str(path), "--llm"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["governing_law"]["value"], got["obligations"][0]["text"], got["_meta"]["llm_used"]) == ("Oz", "pay", True)
    assert schema.Schema(schema.record_schema()).errors(got) == []


def test_providers():
    one, other = enrich.Provider({"api_key": "k"}), enrich.Provider({"api_key": "k", "provider": "local", "model": "m", "base_url": "http://host/v1/"})
    assert json.loads(one.request("hi").data)["max_tokens"] == 1024 and one.request("hi").headers["X-api-key"] == "k"
    assert other.request("hi").full_url == "http://host/v1/chat/completions" and other.request("hi").headers["Authorization"] == "Bearer k"
    assert one.said({"content": [{"text": "a"}, "x", {"text": "b"}]}) == "ab"
    assert other.said({"choices": [{"message": {"content": "c"}}]}) == "c" and other.said({}) is None


def test_linear_in_headings():
    """Twice the headings and signatures cost about twice the time, and a large document ends soon."""
    seconds = []
    for n in (4000, 8000):
        text = "\n".join(f"## Heading {i % 1000} of {i // 1000}\nBy: Signer {i}\nTitle: Clerk\n" for i in range(n))
        began = time.perf_counter()
        assert len(reading.clause_map(reading.detected(text))) == n and len(reading.signatories(text)) == V.MAX_SIGNATORIES
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 4 * seconds[0] + 0.1


def test_gold(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps({"_note": {}, "a.md": {"parties": ["Alder Works LLC", "Nobody"], "effective_date": "2024-05-01", "governing_law": "Delaware", "jurisdiction": "US-DE", "clauses_present": ["Term", "Insurance"]}, "b.md": {"parties": [], "effective_date": None, "governing_law": "Ohio", "jurisdiction": None, "clauses_present": []}}))
    gold = corpus.read_gold(spark, str(path))
    found = records.extract_text(spark.createDataFrame([("a.md", cli.DEMO)], "path string, text string"), keep=("path",)).withColumnRenamed("path", "name")
    got = {r.field: r for r in corpus.accuracy(found, gold).collect()}
    assert (got["parties"].tp, got["parties"].fp, got["parties"].fn) == (1, 1, 1) and got["clauses"].recall == 0.5
    assert [got[f].accuracy for f in ("effective_date", "governing_law", "jurisdiction")] == [1.0, 0.5, 1.0]


def test_files_too_large_are_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "small.md").write_text("# Small")
    (tmp_path / "large.md").write_text("# Large " + "x" * 100)
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 50)
    got = {r.path[-8:]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert got["small.md"].error is None and got["large.md"].text == "" and "larger" in got["large.md"].error
    monkeypatch.setattr(files, "MAX_FILE_BYTES", 5)
    out = inbox.run(inbox.records(inbox.files(spark, str(tmp_path))), str(tmp_path / "out"), str(tmp_path / "state"))
    out.awaitTermination(200)
    assert spark.read.parquet(str(tmp_path / "out")).where("error is not null").count() == 2


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = compare.rows_of_spark(catalog.QUERIES[name](spark, sf_dir))
    assert got == compare.rows_of_sql(compare.connection(sf_dir), catalog.ORACLE_SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_containment_of_all_aliases(spark, tmp_path):
    spark.createDataFrame([("STANDARD TIN",), ("Promo Steel",), ("STANDARD TIN",)], "p_type string").write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for title in {f"{t} {k}" for t in ("standard tin", "promo steel") for _, k, _ in V.aliases()}:
        key = title.lower().rstrip(" .:;,")
        exact = [t for _, k, t in V.aliases() if k == key]
        near = [(len(k), -i, t) for i, k, t in V.aliases() if len(k) >= V.MIN_CONTAINED and (k in key or key in k)]
        want |= {(title, t) for t in exact or ([max(near)[2]] if near else [])}
    got = [(r.title, r.canonical) for r in catalog.QUERIES["clause_canonical_theta"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert len(got) > 2 * len(V.aliases()) // 3
