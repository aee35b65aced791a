"""Readers of many small records: their cost is that of the records, not of a table a record."""

import time

from panweave.sources import genbank


def test_genbank_records_go_back_many_at_a_time(spark, tmp_path):
    record = "LOCUS       c{0} 12 bp    DNA\nVERSION     c{0}\n  ORGANISM  O o\nFEATURES             Location/Qualifiers\n     CDS             complement(1..6)\n                     /locus_tag=\"L{0}\"\n     gene            join(1..3,7..9)\nORIGIN\n        1 aaccggttac gt\n//\n"
    (tmp_path / "x.gb").write_text("".join(record.format(i) for i in range(8000)))
    begun = time.monotonic()
    rows = genbank.features(spark, f"file://{tmp_path}/x.gb").select("contig", "type", "dna", "quals", "parts", "strand").collect()
    assert time.monotonic() - begun < 25  # a table a record took 10 ms and more
    assert len(rows) == 16000
    one = {r["type"]: r for r in rows if r["contig"] == "c7999"}
    assert one["CDS"]["dna"] == "ccggtt"
    assert one["CDS"]["quals"] == {"locus_tag": "L7999"} and one["CDS"]["strand"] == -1
    assert one["gene"]["dna"] == "aactta" and one["gene"]["quals"] == {} and [tuple(p) for p in one["gene"]["parts"]] == [(1, 3, 1), (7, 9, 1)]
