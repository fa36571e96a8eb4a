import hashlib
import time
import uuid

from pyspark.sql import functions as F

from quern.operators import evidence, structure

LAW = """Chương I
Mục 1
Điều 1. Phạm vi
Lời dẫn
1. Một hai
tiếp theo
2. Ba bốn
Chương II
Điều 2. Khác
Không có khoản
"""


def test_units_under_headings(spark):
    docs = spark.createDataFrame([(1, "12/2020/QH14", LAW), (2, None, "chỉ là văn bản\n\nthường"), (3, None, None), (4, None, "")], "doc_id long, document_number string, text string")
    got = [tuple(r) for r in structure.units(docs).orderBy("doc_id", "unit").select("doc_id", "heading_path", "article", "clause", "text").collect()]
    assert got == [
        (1, "Chương I > Mục 1 > Điều 1", "Điều 1", "1", "Điều 1. Phạm vi\nLời dẫn\n1. Một hai\ntiếp theo"),
        (1, "Chương I > Mục 1 > Điều 1", "Điều 1", "2", "Điều 1. Phạm vi\n2. Ba bốn"),
        (1, "Chương II > Điều 2", "Điều 2", None, "Điều 2. Khác\nKhông có khoản"),
        (2, "", None, None, "chỉ là văn bản\n\nthường"),
    ]
    cut = structure.chunks(docs, 5, 1).orderBy("doc_id", "unit", "window").collect()
    assert cut[0].citation == "12/2020/QH14, Điều 1, Khoản 1" and all(r.token_count <= 5 for r in cut)
    assert cut[-1].citation == "ID 2"


def test_identifiers(spark):
    names = ["repo@rev#1", "é", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(structure.name_uuid(F.col("n")).alias("u"), structure.term_id("n").alias("t")).collect()
    assert [r.u for r in got] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert [r.t for r in got] == [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "big") & 0x7FFFFFFF for n in names]


def test_citations(spark):
    texts = ["Khoản 2 Điều 5 Luật 72/2020/QH14 và điều 6", "Theo 1/2019/NĐ-CP, Khoản 3", "2/2018/TT-A", None, "Điều 5", "Điều 1a Khoản 1, Khoản 2 Điều 3 và 5/2001/AB, rồi 6/2002/CD, Điều 1a Khoản 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    rows = sorted(structure.cited(df, "i", "t").collect(), key=lambda r: (r.i, r.n))
    got = [[tuple(r)[2:] for r in rows if r.i == i] for i in range(len(texts))]
    assert got[0] == [("72/2020/QH14", "Điều 5", "Khoản 2"), ("72/2020/QH14", "Điều 6", "")]
    assert got[1] == [("1/2019/NĐ-CP", "", "Khoản 3")]
    assert got[2] == [("2/2018/TT-A", "", "")] and got[3] == []
    assert got[4] == [("", "Điều 5", "")]
    assert got[5] == [("5/2001/AB", "Điều 1a", "Khoản 1"), ("5/2001/AB", "Điều 3", "Khoản 2"), ("6/2002/CD", "Điều 1a", "Khoản 1")]


def test_types_headings_and_inference_text(spark):
    rows = [("12/2020/NĐ-CP", "x", None), ("1/2", "theo bộ luật này", ""), (None, "không", " Luật "), (None, "vô luậtx", None), (None, None, None)]
    df = spark.createDataFrame(rows, "n string, t string, k string")
    assert [r.x for r in df.select(structure.document_type(F.col("n"), F.col("t"), F.col("k")).alias("x")).collect()] == ["Nghị định", "Bộ luật", "Luật", "unspecified", "unspecified"]
    text = spark.createDataFrame([(LAW + "điều 1. phạm vi\nMục 1\n",)], "t string")
    assert text.select(structure.headings(F.col("t"))).first()[0] == ["Chương I", "Mục 1", "Điều 1. Phạm vi", "Chương II", "Điều 2. Khác"]
    assert df.select(structure.inference_text({"A": F.lit(" x  y "), "B": F.lit(None).cast("string")}, F.lit("z"))).first()[0] == "A: x y\nNội dung:\nz"


def test_identity_cascade(spark):
    meta = spark.createDataFrame([(1, "http://a", "1/2 A"), (2, "http://b", "3/4"), (3, "http://b", None)], "document_id long, source_url string, document_number string")
    hints = spark.createDataFrame([(1, 1, "http://b", None), (2, 9, " http://b ", None), (3, None, None, "1/2a"), (4, None, None, "x"), (5, None, None, None)], "case_id long, document_id long, source_url string, document_number string")
    lexical = spark.createDataFrame([(4, 2), (1, 3)], "case_id long, document_id long")
    got = sorted(map(tuple, evidence.resolve_identities(hints, meta, lexical).collect()), key=str)
    assert got == [(1, 1, "exact_doc_id", True), (2, 2, "exact_source_url", True), (2, 3, "exact_source_url", True), (3, 1, "exact_metadata_doc_number", True), (4, 2, "lexical_candidate_fallback", False), (5, None, "not_applicable", True)]


def test_labels_decisions_and_manifests(spark, tmp_path):
    labels = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, status string")
    got = {r.id: (r.status, r.changed) for r in evidence.patched_labels(labels, spark.createDataFrame([(2, "c"), (3, "d")], "id long, status string"), "id", ("status",)).collect()}
    assert got == {1: ("a", False), 2: ("c", True), 3: ("d", True)}
    faults = evidence.decision_faults(labels, spark.createDataFrame([(1,), (1,), (2,), (9,)], "id long"), "id")
    assert {(r.id, r.fault) for r in faults.collect()} == {(1, "duplicate"), (3, "missing"), (9, "extra")}
    for name in "abd":
        (tmp_path / name).write_bytes(name.encode())
    sha = hashlib.sha256(b"a").hexdigest()
    manifest = spark.createDataFrame([("a", 1, sha), ("b", 1, sha), ("c", 1, sha)], "name string, size long, sha256 string")
    found = evidence.manifest_faults(spark.read.format("binaryFile").load(str(tmp_path)), manifest)
    assert {(r["name"], r.fault) for r in found.collect()} == {("b", "hash"), ("c", "missing"), ("d", "unexpected")}


def test_rerank_candidates_in_phases(spark):
    rows = [(1, 1, 10, 0, 0.0), (1, 2, 10, 1, 5.0), (1, 3, 10, 2, 4.0), (1, 4, 10, 3, 3.0), (1, 5, 20, 4, 0.0), (1, 6, 20, 5, 0.0), (1, 7, 30, 6, 1.0)]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id long, position int, score double")
    got = [r.chunk_id for r in evidence.rerank_candidates(hits, 2, 10).orderBy("place").collect()]
    assert got == [2, 3, 7, 5, 6]


def test_a_text_of_a_hundred_thousand_marks(spark):
    n = 25_000
    text = " ".join(f"Khoản {k % 9 + 1} Điều {k + 1} Luật {k % 9000 + 1}/2020/QH{k} xem Điều {k + 1}a" for k in range(n))
    began = time.time()
    got = structure.cited(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").agg(F.count("*").alias("n"), F.count_if(F.col("clause") != "").alias("clauses"), F.countDistinct("document_number").alias("docs")).first()
    assert (got.n, got.clauses, got.docs) == (2 * n, n, n)
    assert time.time() - began < 60
