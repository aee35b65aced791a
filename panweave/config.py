"""Thresholds of the comparative operators, as one immutable record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    evalue: float = 1e-5
    search_evalue: float = 0.01
    database_size: float = 1e8
    identity: float = 1.0
    coverage: float = 75.0
    short_coverage: bool = False  # one side is enough
    homology_identity: float = 0.0
    homology_coverage: float = 20.0
    length_percent: float = 80.0
    max_weight: float = 316.0
    min_bits: float = 28.0
    inflation: float = 1.5
    soft_core: float = 0.95
    growth_samples: int = 10
    min_isoform_overlap: int = 40
    segment_cover: float = 75.0
    intergenic_min: int = 200
    intergenic_max: int = 700
    intergenic_flank: int = 180

    @classmethod
    def transcripts(cls) -> Config:
        """Defaults for nucleotide transcripts."""
        return cls(identity=95.0, homology_identity=70.0, homology_coverage=50.0, growth_samples=20, short_coverage=True)


#: Columns of the long-form tables that operators exchange.
HSPS = "q long, s long, pident double, alen int, qlen int, slen int, qs int, qe int, ss int, se int, evalue double, bits double"
HITS = "q long, s long, tq string, ts string, evalue double, pident double, qcov double, scov double, bits double, rk int"
CLUSTERS = "cluster_id long, seq_id long, taxon string"
PANGENOME = "taxon string, cluster string, n long"
SEQUENCES = "seq_id long, taxon string, header string, seq string"
