"""SQL forms of the derived tables, for checking the queries in DuckDB.

Each entry of ``CTES`` is a named subquery; ``sql`` puts the ones a statement
needs, with what those need, in front of it.
"""

from __future__ import annotations

import math
import re

from massloom.functions import chem

_B = chem.nano(17.002735) - chem.HYDROXYL + chem.HYDROGEN
_Y = chem.nano(17.002735) + 2 * chem.HYDROGEN
_TERMS = chem.nano(1.007825) + chem.nano(17.002735)
_M, _C = chem.nano(15.994915), chem.nano(57.0215)


def _case(letter: str, extra: dict[str, int]) -> str:
    whens = " ".join(f"WHEN '{a}' THEN {m + extra.get(a, 0)}" for a, m in chem.RESIDUE_MASS.items() if a != "_")
    return f"(CASE {letter} {whens} END)::BIGINT"


def _letters(expr: str) -> str:
    return f"[{expr} for i in range(1, length(seq) + 1)]"


def _stable_id(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


def _cut(seq: str) -> str:
    """Fragments: a bar after every R and K, taken back before P, put again in the two exceptions."""
    bars = f"replace(regexp_replace({seq}, '([RK])', '\\1|', 'g'), '|P', 'P')"
    return (
        f"list_filter(string_split(replace(replace({bars}, 'WKP', 'WK|P'), 'MRP', 'MR|P'), '|'), "
        "lambda x: length(x) > 1)"
    )


def _digest(name: str) -> str:
    fit = "length(x) BETWEEN 7 AND 40"
    return f"""
    SELECT protein_id, descr, unnest(list_distinct(
        list_filter(f, lambda x: {fit}) || j1 || c1
        || list_filter([f[i] || f[i+1] || f[i+2] for i in range(1, len(f) - 1)], lambda x: {fit})
        || (CASE WHEN f[1] LIKE 'M%' AND len(f) > 2 THEN
              list_filter([substr(f[1], x + 1) || f[2] || f[3] for x in range(1, len(f) + len(j1) + len(c1))], lambda x: {fit})
            ELSE [] END)
    )) AS seq
    FROM (
        SELECT *, CASE WHEN f[1] LIKE 'M%' AND len(f) > 1 THEN
              list_filter([substr(f[1], x + 1) || f[2] for x in range(1, len(f))], lambda x: {fit})
            ELSE [] END AS c1
        FROM (SELECT *, list_filter([f[i] || f[i+1] for i in range(1, len(f))], lambda x: {fit}) AS j1 FROM {name})
    )"""


def _share(target: str, occ: str, n_bins: str, kernel: dict[int, float], sides: bool, w: int = 75) -> str:
    terms = []
    for k, weight in kernel.items():
        src = f"({target} - ({k}))"
        ok = f"{src} >= 0 AND {src} < {n_bins}"
        if k and sides:
            ok += f" AND {src} < {n_bins} - 1" if k > 0 else f" AND {src} > 0"
        elif k:
            ok += f" AND {src} > {abs(k)} AND {n_bins} - 1 - {src} > {abs(k)}"
        seen = f"({occ} <= {src} + {w - 1} AND ({occ} < {w} OR {occ} >= {src} - {w + 1}))"
        terms.append(
            f"CASE WHEN {ok} THEN {weight!r}::DOUBLE * (CASE WHEN {src} = {occ} THEN {1 + 1 / (2 * w)!r}::DOUBLE ELSE 0e0 END"
            f" - CASE WHEN {seen} THEN {1 / (2 * w)!r}::DOUBLE ELSE 0e0 END) ELSE 0e0 END"
        )
    return "(" + " + ".join(terms) + ")"


def gauss(length: int = 2) -> dict[int, float]:
    return {k: math.exp(-0.5 * k * k) / math.sqrt(2 * math.pi) for k in range(-length, length + 1)}


def halves(length: int = 2) -> dict[int, float]:
    return {k: 0.5 ** abs(k) for k in range(-length, length + 1)}


def corrected(kernel: dict[int, float], sides: bool = False) -> str:
    share = _share("t.bin", "o.bin", "t.n_bins", kernel, sides)
    return sql(
        f"""SELECT t.query_id, t.bin, round(sum(o.value * {share}), 6) AS value
        FROM normed t JOIN normed o ON t.query_id = o.query_id
        AND (abs(t.bin - o.bin) <= 80 OR (o.bin < 75 AND t.bin >= o.bin)) GROUP BY ALL"""
    )


def _modified(source: str, variable: bool) -> str:
    """Candidate rows of merged peptides: modseq, exact mass, residue masses."""
    chosen = "'M[15.994915]'"
    if variable:
        base = f"""
        SELECT m.*, v.chosen FROM {source} m JOIN (
            SELECT seq, []::BIGINT[] AS chosen FROM {source}
            UNION ALL SELECT seq, [p] FROM msites
            UNION ALL SELECT a.seq, [a.p, b.p] FROM msites a JOIN msites b ON a.seq = b.seq AND a.p < b.p
            UNION ALL SELECT a.seq, [a.p, b.p, c.p] FROM msites a JOIN msites b ON a.seq = b.seq AND a.p < b.p
                JOIN msites c ON a.seq = c.seq AND b.p < c.p
        ) v ON m.seq = v.seq"""
    else:
        base = f"SELECT *, []::BIGINT[] AS chosen FROM {source}"
    mark = f"CASE WHEN seq[i] = 'C' THEN 'C[57.0215]' WHEN list_contains(chosen, i) THEN {chosen} ELSE seq[i] END"
    mass = f"{_case('seq[i]', {'C': _C})} + CASE WHEN list_contains(chosen, i) THEN {_M} ELSE 0 END"
    return f"""
    SELECT *, {_stable_id('modseq')} AS cand_id, length(seq)::INTEGER AS length,
        (list_sum(res) + {_TERMS})::BIGINT / 1e9 AS mass
    FROM (SELECT *, array_to_string({_letters(mark)}, '') AS modseq, {_letters(mass)} AS res FROM ({base}))
    WHERE (list_sum(res) + {_TERMS})::BIGINT / 1e9 BETWEEN 250 AND 6000"""


_P = f"{chem.PROTON!r}::DOUBLE"

_EVERY_ID = "(protein_id * 1000000 + k)"


def _planted(sums: str, query_id: str, title: str) -> str:
    return f"""
    SELECT {query_id} AS query_id, {title} AS title, ((protein_id * 17 + k) % 3600)::DOUBLE AS rt,
        (2 + protein_id % 3)::INTEGER AS charge, replace(seq, 'C', 'C[57.0215]') AS truth,
        (sums[-1] + {_TERMS}) / 1e9 * (1e0 + ((protein_id * 13 + k * 29) % 121 - 60) * 1e-6)
            / (2 + protein_id % 3) + {_P} AS pepmass
    FROM {sums}"""


def _peaks(sums: str, query_id: str) -> str:
    return f"""
    SELECT {query_id} AS query_id, (sums[pos] + {_B}) / 1e9 * (1e0 + ((protein_id * 7 + pos * 11) % 17 - 8) * 1e-6) AS mz,
        1e0 + (protein_id * 5 + pos * 37) % 100 AS intensity
    FROM (SELECT *, unnest(range(1, len(sums))) AS pos FROM {sums})
    UNION ALL
    SELECT {query_id}, (sums[-1] - sums[pos - 1] + {_Y}) / 1e9 * (1e0 + ((protein_id * 7 + pos * 11) % 17 - 8) * 1e-6),
        1e0 + (protein_id * 5 + pos * 37) % 100
    FROM (SELECT *, unnest(range(2, len(sums) + 1)) AS pos FROM {sums})
    UNION ALL
    SELECT {query_id}, 100e0 + i * 25e0 + abs(embedding[i + 1]::DOUBLE) * 10e0, (1 + (i * 7) % 10)::DOUBLE
    FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings) JOIN {sums} ON vec_id = protein_id"""


def _spectra(planted: str) -> str:
    return f"""
    SELECT *, mass + -100e0 * 1e-6 * mass AS min_mass, mass + 100e0 * 1e-6 * mass AS max_mass
    FROM (SELECT *, pepmass * charge - (charge - 1) * {_P} - {_P} AS mass FROM {planted})
    WHERE mass BETWEEN 250 AND 6000 AND charge BETWEEN 2 AND 4"""


CTES = {
    "proteins": """
    SELECT doc_id AS protein_id, source || '_' || doc_id AS descr,
        upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS seq
    FROM documents""",
    "reversed": "SELECT protein_id, 'DECOY_' || descr AS descr, reverse(seq) AS seq FROM proteins",
    "flists": f"SELECT protein_id, descr, {_cut('seq')} AS f FROM proteins",
    "dlists": f"SELECT protein_id, descr, {_cut('seq')} AS f FROM reversed",
    "frags": "SELECT protein_id, descr, unnest(f) AS seq, generate_subscripts(f, 1) - 1 AS k FROM flists",
    "peps": _digest("flists"),
    "dpeps": _digest("dlists"),
    "mlists": f"SELECT protein_id, descr, {_cut("'M' || seq")} AS f FROM proteins",
    "mpeps": _digest("mlists"),
    "merged": """
    SELECT seq, bool_and(decoy) AS decoy,
        CASE WHEN bool_and(decoy) THEN string_agg(descr, ';' ORDER BY descr)
             ELSE string_agg(descr, ';' ORDER BY descr) FILTER (NOT decoy) END AS descr
    FROM (SELECT seq, descr, false AS decoy FROM peps UNION ALL SELECT seq, descr, true FROM dpeps) GROUP BY seq""",
    "msites": """
    SELECT seq, unnest(list_filter(range(1, length(seq) + 1), lambda i: seq[i] = 'M')) AS p FROM merged""",
    "cands": _modified("merged", True),
    "plain": """
    SELECT seq, false AS decoy, string_agg(descr, ';' ORDER BY descr) AS descr
    FROM (SELECT DISTINCT protein_id, descr, seq FROM frags WHERE length(seq) BETWEEN 7 AND 40) GROUP BY seq""",
    "pcands": _modified("plain", False),
    "picked": """
    SELECT protein_id, s.seq AS seq, s.k AS k FROM (
        SELECT protein_id, min({'seq': seq, 'k': k}) AS s FROM frags WHERE length(seq) BETWEEN 7 AND 40 GROUP BY protein_id)""",
    "pres": f"SELECT *, {_letters(_case('seq[i]', {'C': _C}))} AS res FROM picked",
    "psums": "SELECT *, [list_sum(res[1:j])::BIGINT for j in range(1, len(res) + 1)] AS sums FROM pres",
    "planted": _planted("psums", "protein_id", "'s' || protein_id"),
    "peaks": _peaks("psums", "protein_id"),
    "spectra": _spectra("planted"),
    # the same with a spectrum for every eligible fragment
    "every_pres": f"""
    SELECT *, {_letters(_case('seq[i]', {'C': _C}))} AS res FROM frags WHERE length(seq) BETWEEN 7 AND 40""",
    "every_psums": "SELECT *, [list_sum(res[1:j])::BIGINT for j in range(1, len(res) + 1)] AS sums FROM every_pres",
    "every_planted": _planted("every_psums", _EVERY_ID, "'s' || protein_id || '_' || k"),
    "every_peaks": _peaks("every_psums", _EVERY_ID),
    "every_spectra": _spectra("every_planted"),
    "pairs": """
    SELECT s.query_id, s.charge, s.mass AS query_mass, c.cand_id, c.mass AS cand_mass, c.length, c.seq, c.modseq, c.res
    FROM spectra s JOIN cands c ON c.mass BETWEEN s.min_mass AND s.max_mass""",
}


def _ions(pairs: str) -> str:
    return f"""
    SELECT cand_id, length, series, z, pos,
        ((nano + (CASE series WHEN 'b' THEN {_B} ELSE {_Y} END) + {chem.HYDROGEN} * (z - 1)) / 1e9 / z - 0e0) / z AS mz
    FROM (
        SELECT cand_id, length, 'b' AS series, pos, list_sum(res[1:pos])::BIGINT AS nano
        FROM (SELECT *, unnest(range(1, length)) AS pos FROM (SELECT DISTINCT cand_id, length, res FROM {pairs}))
        UNION ALL
        SELECT cand_id, length, 'y', pos, list_sum(res[length - pos + 1:])::BIGINT
        FROM (SELECT *, unnest(range(1, length)) AS pos FROM (SELECT DISTINCT cand_id, length, res FROM {pairs}))
    ), (SELECT unnest([1, 2, 3]) AS z)"""


def _matches(pairs: str, ions: str) -> str:
    return f"""
    SELECT p.query_id, p.cand_id, p.charge, p.length, i.series, i.z, i.pos, s.peak, s.share, s.norm,
        abs((s.mz - i.mz) / s.mz * 1e6) AS delta
    FROM {pairs} p JOIN {ions} i ON p.cand_id = i.cand_id AND i.z < p.charge
    JOIN (
        SELECT *, unnest([floor(mz / 0.25e0) - 1, floor(mz / 0.25e0), floor(mz / 0.25e0) + 1]) AS b FROM (
            SELECT query_id, mz, row_number() OVER (PARTITION BY query_id ORDER BY mz, intensity) AS peak,
                intensity / max(intensity) OVER (PARTITION BY query_id) AS share,
                max(intensity) OVER (PARTITION BY query_id) AS norm
            FROM peaks) WHERE share > 0.01e0
    ) s ON s.query_id = p.query_id AND floor(i.mz / 0.25e0) = s.b
    WHERE abs((s.mz - i.mz) / s.mz * 1e6) <= 20"""


def _hyper(matches: str) -> str:
    return f"""
    SELECT query_id, cand_id, charge, length, total_matched, sum_all, norm,
        least(pow(sum_all, least(2, least(charge - 1, 3))) *
            CASE WHEN charge = 2 THEN f1
                 WHEN charge = 3 THEN f1 * f2
                 ELSE greatest(f1 * f2, f1 * f3, f2 * f3) END, 1.7976931348623157e308) AS score
    FROM (
        SELECT query_id, cand_id, charge, length, norm, count(*) AS total_matched, sum(round_even(share * 1e12, 0)::BIGINT) / 1e12 AS sum_all,
            factorial(least(20, count(*) FILTER (z = 1))::INTEGER)::DOUBLE AS f1,
            factorial(least(20, count(*) FILTER (z = 2))::INTEGER)::DOUBLE AS f2,
            factorial(least(20, count(*) FILTER (z = 3))::INTEGER)::DOUBLE AS f3
        FROM (SELECT DISTINCT query_id, cand_id, charge, length, norm, peak, share, series, z FROM {matches}) GROUP BY ALL)"""


def _xcorr(pairs: str, ions: str) -> str:
    share = _share("i.bin", "o.bin", "i.n_bins", gauss(), False)
    return f"""
    SELECT i.query_id, i.cand_id, i.charge, i.length, sum(round_even(o.value * {share} * 1e12, 0)::BIGINT) / 1e12 AS score,
        count(*) FILTER (i.bin = o.bin) AS total_matched,
        coalesce(sum(round_even(o.value * 1e12, 0)::BIGINT) FILTER (i.bin = o.bin) / 1e12, 0e0) AS sum_i
    FROM (
        SELECT DISTINCT p.query_id, p.cand_id, p.charge, p.length, g.n_bins, floor(i.mz / g.res)::INTEGER AS bin
        FROM {pairs} p JOIN grid g ON p.query_id = g.query_id JOIN {ions} i ON p.cand_id = i.cand_id AND i.z < p.charge
        WHERE floor(i.mz / g.res) < g.n_bins
    ) i JOIN (
        SELECT *, unnest([(bin - 80) // 200, (bin + 80) // 200]) AS b FROM normed WHERE (bin - 80) // 200 <> (bin + 80) // 200
        UNION ALL SELECT *, bin // 200 FROM normed WHERE (bin - 80) // 200 = (bin + 80) // 200
    ) o ON i.query_id = o.query_id AND i.bin // 200 = o.b
    WHERE abs(i.bin - o.bin) <= 80
    GROUP BY ALL HAVING sum(round_even(o.value * {share} * 1e12, 0)::BIGINT) > 0"""


CTES |= {
    "ions": _ions("pairs"),
    "matches": _matches("pairs", "ions"),
    "hyper": _hyper("matches"),
    "grid": """
    SELECT query_id, mass, max_mz, res, (floor(max_mz / res) + 76)::INTEGER AS n_bins,
        floor(least(floor((mass + 50) / res), floor(max_mz / res)) / 10 + 1)::INTEGER AS stretch
    FROM (SELECT *, greatest(max_mz * 1e-6 * 20e0, 0.001e0) AS res
          FROM (SELECT query_id, mass, max(mz) AS max_mz FROM spectra JOIN peaks USING (query_id) GROUP BY ALL))""",
    "normed": """
    SELECT query_id, bin, n_bins, v * (1e0 / max(v) OVER (PARTITION BY query_id, bin // stretch)) AS value
    FROM (SELECT query_id, n_bins, stretch, floor(mz / res)::INTEGER AS bin, sqrt(max(intensity)) AS v
          FROM grid JOIN peaks USING (query_id) GROUP BY ALL)
    WHERE bin // stretch < 10
    QUALIFY v > 0.05e0 * max(v) OVER (PARTITION BY query_id)""",
    "xc": _xcorr("pairs", "ions"),
    "joint": """
    SELECT *, greatest(0e0, x, r, x * r) AS score FROM (
        SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.cand_id, b.cand_id) AS cand_id,
            coalesce(a.score, 0e0) AS x, coalesce(b.score, 0e0) AS h, sqrt(log10(coalesce(b.score, 0e0) + 1)) AS r,
            coalesce(a.score, b.score) AS rawscore, coalesce(a.total_matched, b.total_matched) AS total_matched,
            coalesce(a.sum_i, log10(b.sum_all * b.norm)) AS sum_i, coalesce(a.length, b.length) AS length,
            coalesce(a.charge, b.charge) AS charge
        FROM xc a FULL OUTER JOIN hyper b ON a.query_id = b.query_id AND a.cand_id = b.cand_id)
    WHERE greatest(0e0, x, r, x * r) > 0""",
    "best": """
    SELECT b.*, p.seq, p.modseq, p.query_mass, p.cand_mass, c.descr, c.decoy, s.title, s.truth
    FROM (SELECT * FROM joint QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id) <= 10) b
    JOIN pairs p USING (query_id, cand_id) JOIN cands c USING (cand_id) JOIN spectra s USING (query_id)""",
    "ev_peaks": "SELECT user_id AS query_id, 100e0 + value * 4 AS mz, (event_id % 97 + 1)::DOUBLE AS intensity FROM events",
    "ev_psms": """
    SELECT event_id AS psm_id, user_id AS query_id, 'u' || user_id AS title,
        (CASE WHEN event_type = 'error' THEN 'DECOY_' ELSE '' END) || event_type AS descr,
        event_type || floor(value / 5)::BIGINT AS seq,
        event_type || floor(value / 5)::BIGINT || '[' || event_id % 3 || ']' AS modseq,
        length(event_type || floor(value / 5)::BIGINT)::INTEGER AS length,
        round(value) AS score, event_type = 'error' AS decoy, (2 + user_id % 3)::INTEGER AS charge,
        500e0 + user_id * 11.37e0 AS query_mass,
        500e0 + user_id * 11.37e0 + (event_id % 7) * 0.001e0 AS cand_mass, event_id % 13 AS total_matched
    FROM events""",
    "top1": """
    SELECT * FROM ev_psms QUALIFY row_number() OVER (PARTITION BY title ORDER BY score DESC, psm_id) = 1""",
    "top10": """
    SELECT *, (score - min(score) OVER (PARTITION BY query_id)) / CASE WHEN score <> 0 THEN score ELSE 1 END AS delt
    FROM (SELECT * FROM ev_psms QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, psm_id) <= 10)""",
}


def levels(source: str, score: str = "score", decoy: str = "decoy", by: str = "") -> str:
    """Score levels of a table with running counts, fdr and q."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""
    SELECT *, min(fdr) OVER ({part} ORDER BY {score} ROWS UNBOUNDED PRECEDING) AS q FROM (
        SELECT *, least(1e0, cum_decoys / greatest(cum_targets, 1)) AS fdr FROM (
            SELECT *, sum(n) OVER w AS cum_n, sum(targets) OVER w AS cum_targets, sum(decoys) OVER w AS cum_decoys FROM (
                SELECT {keys}{score}, count(*) AS n, count(*) FILTER (NOT {decoy}) AS targets, count(*) FILTER ({decoy}) AS decoys
                FROM {source} GROUP BY ALL)
            WINDOW w AS ({part} ORDER BY {score} DESC ROWS UNBOUNDED PRECEDING)))"""


CTES |= {
    "lv_all": levels("ev_psms"),
    "lv_top": levels("top1"),
    "curve": "SELECT q, max(cum_n) AS n FROM lv_top GROUP BY q",
}


def sql(statement: str, **more: str) -> str:
    """A statement with the subqueries it names in front."""
    known = CTES | more
    order: list[str] = []

    def need(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+([a-z_0-9]+)", text)):
            if word in known and word not in order:
                need(known[word])
                order.append(word)

    need(statement)
    if not order:
        return statement
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({known[name].strip()})" for name in order)
    return f"WITH {ctes}\n{statement}"
