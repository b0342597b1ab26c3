"""Headline timings: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from check_oracle import session
from massloom.operators import fdr, pin, report
from massloom.operators.candidates import build_candidates
from massloom.operators.digest import digest
from massloom.operators.precursor import precursor_join
from massloom.operators.search import score_combined, score_hyperscore, score_xcorr, search
from massloom.plans import fixtures as fx
from massloom.sources.stages import materialize

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CORES = int(os.environ.get("BENCH_CPUS", "8"))


def main() -> None:
    spark = session(CORES)
    seconds: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name: str, build) -> None:
        start = time.time()
        out = build()
        n = out.count() if isinstance(out, DataFrame) else out
        seconds[name], rows[name] = round(time.time() - start, 3), n
        print(f"{name:24s} {seconds[name]:8.2f}s {n:>12}", file=sys.stderr, flush=True)

    def written(df: DataFrame) -> int:
        """Compute every column, keep nothing."""
        seen = df.select(F.hash(*df.columns).alias("h")).agg(F.count("h")).first()[0]
        return seen

    proteins = fx.proteins(spark, SF_DIR)
    timed("warm_up", lambda: written(proteins))
    timed("digest_tryptic", lambda: written(fx.fragment_rows(spark, SF_DIR)))
    timed("digest_missed_cleavages", lambda: written(digest(proteins)))
    tables = {}

    def stage(name, build):
        tables[name] = materialize(build())
        return tables[name]

    timed("candidate_table", lambda: stage("full", lambda: build_candidates(proteins)))
    timed("spectra", lambda: stage("spectra", lambda: fx.spectra(spark, SF_DIR)))
    spectra, cands = tables["spectra"], tables["full"]
    timed("precursor_range_join", lambda: precursor_join(spectra.drop("peaks"), cands.select("cand_id", "mass")))
    timed("hyperscore_score", lambda: written(score_hyperscore(spectra, cands)))
    timed("xcorr_score", lambda: written(score_xcorr(spectra, cands)))
    timed("combined_score", lambda: written(score_combined(spectra, cands)))
    timed("search_topn", lambda: stage("psms", lambda: search(spectra, cands, retain=10)))
    timed("pin_table", lambda: written(pin.pin_features(tables["psms"])))
    events = fx.event_psms(spark, SF_DIR)
    timed("qvalues", lambda: written(fdr.with_qvalue(events)))
    timed("fdr_summary", lambda: written(fdr.fdr_summary(fdr.reported(events))))
    timed("score_by_mass_decile", lambda: written(report.scores_by_decile(events, "query_mass")))
    warm = seconds.pop("warm_up")
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CORES,
                "warm_up": warm,
                "rows": {k: v for k, v in rows.items() if k in seconds},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
