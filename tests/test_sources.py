import pytest
from pyspark.sql import functions as F

from tesseral.operators import ranges
from tesseral.sources import observations as so
from tesseral.sources import sequences, variants
from tesseral.streaming import calls as stream

LINES = """##fileformat=VCFv4.3
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts
1\t10\t.\ta\tC,<*>,<FOO>\t9.5\tPASS\tDP=3;IMPRECISE\tDP:AF\t3:0.5
1\t20\tx\tAT\tA\t.\t.\t.
1\t30\t.\tA\tAGG\t.\t.\tNOTE=a%3Bb
1\t40\t.\tAC\tGT\t.\t.\t.
1\t50\t.\tACG\tTT\t.\t.\t.
1\t60\t.\tN\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-7
1\t70\t.\tN\t<INV>\t.\t.\tSVTYPE=INV;END=79
1\t80\tb1\tT\tT[1:9[\t.\t.\tSVTYPE=BND;MATEID=b2
1\t90\t.\tT\tT[1:9[\t.\t.\tSVTYPE=BND
1\t95\t.\tN\t<DEL>\t.\t.\tSVTYPE=DEL;IMPRECISE;SVLEN=5
"""


def test_variant_text(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(LINES)
    path = str(tmp_path / "a.vcf")
    records = variants.read_records(spark, path)
    assert records.count() == 10 and variants.header_samples(spark, path) == ["s"]
    first = records.where("pos = 10").first()
    assert first["qual"] == 9.5 and first["info"] == {"DP": "3", "IMPRECISE": ""} and first["samples"] == ["3:0.5"]
    assert records.where("pos = 30").select(variants.info("NOTE").alias("n")).first()["n"] == "a;b"
    got = {(r["pos"], r["allele"]): (r["vartype"], r["length"], r["seq"], r["skip"]) for r in variants.decompose(records).collect()}
    assert got == {
        (10, 0): ("SNV", None, "C", None), (10, 1): ("REF", None, None, None), (10, 2): (None, None, None, "other_symbol"), (20, 0): ("DEL", 1, None, None), (30, 0): ("INS", 2, "GG", None), (40, 0): ("MNV", 2, "GT", None), (50, 0): ("REP", None, "TT", None),
        (60, 0): ("DEL", 7, None, None), (70, 0): ("INV", 10, None, None), (80, 0): ("BND", None, "T[1:9[", None), (90, 0): (None, None, None, "breakend_no_event"), (95, 0): (None, None, None, "imprecise"),
    }
    calls = records.select("chrom", "pos", "id", "ref", "alt", F.lit(0.5).alias("af"))
    head = variants.header([("1", 100)], {}, {"AF": ("1", "Float", "frequency")}, ["s"])
    variants.write_calls(calls, str(tmp_path / "out"), head, [], {"s": {"AF": "af"}})
    again = variants.read_records(spark, str(tmp_path / "out" / "records"))
    assert again.count() == 10 and again.first()["samples"] == ["0.5"]
    assert variants.parse_lines(spark.createDataFrame([(None,), ("",)], "value string"), "value").count() == 0


def test_sequences_and_alignments(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">c1 first\nACGT\nAC\n>c2\n\nGG\n")
    contigs = sequences.read_fasta(spark, str(tmp_path / "r.fa"))
    assert {r["contig"]: r["seq"] for r in contigs.collect()} == {"c1": "ACGTAC", "c2": "GG"}
    loci = spark.createDataFrame([("c1", 3), ("c1", 5), ("c2", 1), ("c3", 0)], "chrom string, at long")
    got = {(r["chrom"], r["at"]): r["b"] for r in ranges.with_reference_base(loci, contigs, "chrom", "at", 2, "b", 4).collect()}
    assert got == {("c1", 3): "TA", ("c1", 5): None, ("c2", 1): None, ("c3", 0): None}
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nq1\t99\tc1\t5\t60\t3M\t=\t10\t8\tACG\tI5!\tXA:Z:c2,+7,3M,0;\tEF:i:1\nq2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    rows = {r["name"]: r for r in sequences.read_alignments(spark, str(tmp_path / "a.sam")).collect()}
    assert rows["q1"]["pos"] == 4 and rows["q1"]["quals"] == [40, 20, 0] and rows["q1"]["tags"] == {"XA": "c2,+7,3M,0;", "EF": "1"}
    assert rows["q2"]["contig"] is None and rows["q2"]["quals"] is None


def test_observations_keep_their_lineage(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", -0.1), (2, "t", -0.2)], "variant long, sample string, ln_map double")
    so.write_observations(df, str(tmp_path / "t"), {"max_depth": 200})
    assert so.read_lineage(spark, str(tmp_path / "t")) == {"max_depth": 200}
    got = so.read_observations(spark, {"tumor": str(tmp_path / "t")}, ["normal", "tumor"])
    assert got.where("sample = 'tumor'").count() == 2
    with pytest.raises(ValueError):
        so.read_observations(spark, {"other": str(tmp_path / "t")}, ["tumor"])
    with pytest.raises(ValueError):
        so.load_properties('{"insert_size": {"mean": 1, "sd": 0}}')
    so.write_delimited(df, str(tmp_path / "d"))
    so.plot_table(df.select("variant", "ln_map"), str(tmp_path / "p.json"), "point", "variant", "ln_map")
    assert '"mark": "point"' in (tmp_path / "p.json").read_text()


def test_stream_of_calls(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(LINES)
    query = variants.decompose(stream.stream_records(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("decomposed").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("decomposed").where("vartype is not null").count() == 9
    rows = [(1, "DEL", "2024-01-01 10:00:00"), (1, "DEL", "2024-01-02 10:00:00"), (2, "INS", "2024-01-01 11:00:00")]
    spark.createDataFrame(rows, "call_id long, svtype string, loaded_at string").withColumn("loaded_at", F.to_timestamp("loaded_at")).write.parquet(str(tmp_path / "calls"))
    arrived = spark.readStream.schema("call_id long, svtype string, loaded_at timestamp").parquet(str(tmp_path / "calls"))
    query = stream.counts_per_window(stream.delivered_once(arrived), late=None).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert query.exception() is None
