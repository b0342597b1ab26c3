"""Peptide identification from tandem mass spectra as Spark DataFrame jobs."""

from massloom.options import (
    DigestOptions,
    HyperscoreOptions,
    IonOptions,
    PinOptions,
    QueryOptions,
    ReportOptions,
    SearchOptions,
    XcorrOptions,
)

__all__ = [
    "DigestOptions",
    "HyperscoreOptions",
    "IonOptions",
    "PinOptions",
    "QueryOptions",
    "ReportOptions",
    "SearchOptions",
    "XcorrOptions",
]
