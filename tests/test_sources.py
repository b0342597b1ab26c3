"""Files in and out."""

import pytest
from pyspark.sql import functions as F

from massloom.sources import fasta, mgf, tables

FASTA = ">sp|1 first > still header\nACDE\nFGHI \n>second\nKLM\n>empty\n"
MGF = """# a comment
BEGIN IONS
TITLE=one
RTINSECONDS=12.5
PEPMASS=500.25 1000
CHARGE=2+
SEQ=PEPTIDE
100.5 10
200.25\t20.5 1+
END IONS
BEGIN IONS
TITLE=two
PEPMASS=300.5
CHARGE=2+ and 3+
END IONS
BEGIN IONS
TITLE=three
CHARGE=x
SEQ=K
1e2 3
END IONS
"""


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    path = write(tmp_path, "p.fasta", FASTA)
    rows = {r["desc"]: r["seq"] for r in fasta.read_fasta(spark, path).collect()}
    assert rows == {"sp|1 first > still header": "ACDEFGHI", "second": "KLM", "empty": ""}
    assert fasta.count_proteins(spark, path).first()["n"] == 3


def test_mgf(spark, tmp_path):
    path = write(tmp_path, "s.mgf", MGF)
    rows = {r["title"]: r for r in mgf.read_mgf(spark, path, ("SEQ",)).collect()}
    assert set(rows) == {"one", "two", "three"}
    one = rows["one"]
    assert (one["rt"], one["charge"], one["pepmass"], one["meta"]["mgf:SEQ"]) == (12.5, 2, 500.25, "PEPTIDE")
    assert [(p["mz"], p["intensity"]) for p in one["peaks"]] == [(100.5, 10.0), (200.25, 20.5)]
    assert rows["two"]["peaks"] == [] and rows["two"]["charge"] == 2 and rows["two"]["meta"]["mgf:SEQ"] is None
    assert rows["three"]["charge"] is None and rows["three"]["pepmass"] is None
    assert mgf.count_spectra(spark, path).first()["n"] == 3


def test_missing_mgf_field_is_an_error(spark, tmp_path):
    path = write(tmp_path, "s.mgf", MGF)
    with pytest.raises(Exception, match="no key SEQ in spectrum two"):
        mgf.read_mgf_fields(spark, path, "SEQ").collect()


def test_windows_line_ends(spark, tmp_path):
    path = write(tmp_path, "w.mgf", MGF.replace("\n", "\r\n"))
    rows = {r["title"]: r for r in mgf.read_mgf(spark, path).collect()}
    assert rows["one"]["charge"] == 2 and len(rows["one"]["peaks"]) == 2


def test_external_scores(spark):
    psms = spark.createDataFrame([("a", "AK", 1.0), ("a", "CK", 2.0), ("b", "AK", 3.0)], "title string, modseq string, score double")
    t = spark.createDataFrame([("a", "9.5", "-.AK.-")], "PSMId string, score string, peptide string")
    d = spark.createDataFrame([("b", "0.5", "-.AK.-")], "PSMId string, score string, peptide string")
    rows = {(r["title"], r["modseq"]): r["score"] for r in tables.import_external_scores(psms, t, d).collect()}
    assert rows == {("a", "AK"): 9.5, ("b", "AK"): 0.5}


def test_positional_numbers(spark):
    df = spark.createDataFrame([(1.0,), (0.1234567890123456,), (1e-20,), (12345678.5,)], "v double")
    assert [r[0] for r in df.select(tables.decimal_text(F.col("v"))).collect()] == ["1.0", "0.123456789012", "0.0", "12345678.5"]


def test_numbers_are_places_in_the_files(spark, tmp_path):
    """However the files are split and packed into tasks."""
    names, sizes = [], [300, 1, 0, 47, 900]
    for i, n in enumerate(sizes):
        own = [f"p{i}_{k}" for k in range(n)]
        names += own
        body = "".join(f">{x}\nACDE\n" + "FGHIKL" * (len(x) % 5 * 9) + "\n" for x in own) + "\n"
        write(tmp_path, f"f{i}.fasta", body)
        mgf_body = "".join(f"# c\nBEGIN IONS\nTITLE={x}\nPEPMASS=5{len(x)}.5\nCHARGE=2+\n" + "100.5 1\n" * (len(x) % 4 * 11) + "END IONS\n" for x in own)
        write(tmp_path, f"f{i}.mgf", mgf_body + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for most, cost in (("128m", "4m"), ("1000b", "0"), ("7000b", "2000"), ("333b", "10")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            proteins = fasta.read_fasta(spark, str(tmp_path / "*.fasta"))
            spectra = mgf.read_mgf(spark, str(tmp_path / "*.mgf"))
            assert [r["desc"] for r in sorted(proteins.collect(), key=lambda r: r["protein_id"])] == names
            assert sorted(r["protein_id"] for r in proteins.collect()) == list(range(len(names)))
            assert {r["query_id"]: r["title"] for r in spectra.collect()} == dict(enumerate(names))
            assert spectra.where("charge = 2 and query_id >= 348").count() == 900
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
