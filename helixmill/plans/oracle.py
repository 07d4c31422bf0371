"""DuckDB SQL that gives the same rows as the k-mer queries, written independently of them."""

from __future__ import annotations

from helixmill.functions.dna import MAX_QUALITY, quality_probabilities
from helixmill.operators.error_model import kernel_weights
from helixmill.operators.model import zeta
from helixmill.sources.fixture import duckdb_ctes

_K = 15
_PROBABILITIES = "[" + ", ".join(f"CAST({p!r} AS DOUBLE)" for p in quality_probabilities()) + "]"
_KERNEL = "[" + ", ".join(map(str, kernel_weights())) + "]"

_STEPS = {
    "reads": "",
    "windows": f"w AS (SELECT read_id, pos, substring(seq, CAST(pos AS INT) + 1, {_K}) AS f FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {_K - 1})) AS pos FROM reads WHERE length(seq) >= {_K}))",
    "kmers": "c AS (SELECT read_id, pos, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer FROM w WHERE f NOT LIKE '%N%')",
    "counts": "counts AS (SELECT kmer, count(*) AS n FROM c GROUP BY kmer)",
    "good": "good AS (SELECT kmer, n FROM counts WHERE n >= 4)",
    "weights": f"""ps AS (SELECT read_id, seq, list_transform(string_split(qual, ''), lambda x: {_PROBABILITIES}[ascii(x) - 32]) AS p FROM reads),
pw AS (SELECT read_id, seq, p, unnest(range(0, length(seq) - {_K - 1})) AS pos FROM ps),
v AS (SELECT read_id, substring(seq, CAST(pos AS INT) + 1, {_K}) AS f, list_reduce(list_slice(p, pos + 1, pos + {_K}), lambda x, y: x * y) AS weight FROM pw),
q AS (SELECT read_id, least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AS kmer, weight FROM v WHERE f NOT LIKE '%N%')""",
    "fixed": "fixed AS (SELECT kmer, CAST(sum(CAST(floor(weight * 1000000) AS BIGINT)) AS BIGINT) AS q FROM q WHERE weight > 0.0001 GROUP BY kmer)",
    "bad": "bad AS (SELECT read_id, pos FROM w WHERE f LIKE '%N%' UNION ALL SELECT c.read_id, c.pos FROM c WHERE c.kmer NOT IN (SELECT kmer FROM good))",
    "comps": f"""gaps AS (SELECT read_id, pos, CASE WHEN lag(pos) OVER (PARTITION BY read_id ORDER BY pos) + {_K - 1} < pos THEN 1 ELSE 0 END AS gap FROM bad),
runs AS (SELECT read_id, pos, sum(gap) OVER (PARTITION BY read_id ORDER BY pos) AS component FROM gaps),
comps AS (SELECT read_id, CAST(component AS BIGINT) AS component, min(pos) AS a, max(pos) AS b, count(*) AS num FROM runs GROUP BY read_id, component)""",
    "cores": f"""covered AS (SELECT DISTINCT read_id, CAST(component AS BIGINT) AS component, unnest(range(pos, pos + {_K})) AS place FROM runs),
cores AS (
  SELECT comps.read_id, comps.component, a, b, place FROM comps JOIN covered USING (read_id, component)
  WHERE b > a + {_K - 1} OR place BETWEEN b AND a + {_K - 1})""",
}
_ORDER = list(_STEPS)
_NEEDS = {"reads": [], "windows": [], "kmers": ["windows"], "counts": ["kmers"], "good": ["counts"], "weights": [], "fixed": ["weights"], "bad": ["good"], "comps": ["bad"], "cores": ["comps"]}


def _with(*steps: str, more: str = "", base: str | None = None, given: tuple[str, ...] = ()) -> str:
    wanted: set[str] = set()

    def add(step: str) -> None:
        for s in _NEEDS[step]:
            add(s)
        wanted.add(step)

    for step in steps:
        add(step)
    parts = [base or duckdb_ctes().strip(), *(_STEPS[s] for s in _ORDER if s in wanted and _STEPS[s] and s not in given), *([more] if more else [])]
    return "WITH " + ",\n".join(parts) + "\n"


def _trim(phred: str, threshold: int) -> str:
    """trims(read_id, n, trim_len): the cut with the largest positive suffix sum, rightmost of equals."""
    return f"""bases AS (SELECT read_id, length(qual) AS n, unnest(range(0, length(qual))) AS i, unnest(string_split(qual, '')) AS ch FROM reads),
sums AS (SELECT read_id, n, i, sum({threshold} - {phred}) OVER (PARTITION BY read_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS s FROM bases),
tops AS (SELECT read_id, n, i, s, row_number() OVER (PARTITION BY read_id ORDER BY s DESC, i DESC) AS r FROM sums),
trims AS (SELECT read_id, n, CASE WHEN s > 0 THEN i ELSE n END AS trim_len FROM tops WHERE r = 1)"""


_RAW = "(ascii(ch) - 33)"
_FOUND = (
    _trim(_RAW, 3)
    + """,
kept AS (
  SELECT r.read_id, r.seq, r.qual, substring(CASE WHEN r.read_id % 97 = 0 THEN r.seq ELSE r.truth END, 1, CAST(CASE WHEN r.read_id % 11 = 0 THEN 20 ELSE trim_len END AS INT)) AS cor
  FROM reads r JOIN trims USING (read_id)),
marked AS (
  SELECT *, cor != substring(seq, 1, length(cor)) AS changed, length(seq) - length(cor) AS cut,
         CASE WHEN length(cor) < 30 THEN 'removed'
              WHEN cor != substring(seq, 1, length(cor)) THEN CASE WHEN length(cor) < length(seq) THEN 'corrected_trimmed' ELSE 'corrected' END
              WHEN length(cor) < length(seq) THEN 'trimmed' ELSE 'validated' END AS status FROM kept)"""
)
_PLANTED = """planted AS (
  SELECT read_id, p, ascii(substring(qual, p + 1, 1)) - 33 AS q, substring(truth, p + 1, 1) AS actual, substring(seq, p + 1, 1) AS observed
  FROM (SELECT *, error_at AS p FROM reads WHERE error_at >= 0)
  WHERE substring(truth, p + 1, 1) != substring(seq, p + 1, 1))"""
_CHANGES = """ch AS (
  SELECT read_id, pos, substring(truth, CAST(pos AS INT), 1) AS new_nt, substring(seq, CAST(pos AS INT), 1) AS old_nt
  FROM (SELECT read_id, truth, seq, unnest(range(1, length(truth) + 1)) AS pos FROM reads)
  WHERE substring(truth, CAST(pos AS INT), 1) != substring(seq, CAST(pos AS INT), 1))"""
_AT = "length(kmer) - length(replace(replace(kmer, 'A', ''), 'T', ''))"
_PACKED = "list_reduce(list_transform(string_split(translate({}, 'ACGT', '0123'), ''), lambda x: CAST(x AS BIGINT)), lambda a, b: a * 4 + b)"
_DRAW = f"({_PACKED.format('kmer')} % 1000003 * 7919) % 1000003"
_PLACES = "string_agg(CAST(place AS VARCHAR), ',' ORDER BY place)"


def _region_sql(chop: bool, **how) -> str:
    """Places of the regions in their order: core, then descending to 0, then ascending to the end."""
    k = _K
    if not chop:
        return _with("cores", **how, more=f"""spans AS (SELECT read_id, component, any_value(a) AS a, any_value(b) AS b, min(place) AS f, max(place) AS l FROM cores GROUP BY read_id, component),
places AS (
  SELECT read_id, component, 0 AS part, place, place AS o FROM cores
  UNION ALL SELECT read_id, component, 1, place, -place FROM (SELECT read_id, component, unnest(range(0, f)) AS place FROM spans WHERE {k - 1} >= f)
  UNION ALL SELECT read_id, component, 2, place, place FROM (SELECT s.read_id, component, unnest(range(l + 1, length(seq))) AS place FROM spans s JOIN reads USING (read_id) WHERE length(seq) - {k} <= l))""") + "SELECT read_id, component, string_agg(CAST(place AS VARCHAR), ',' ORDER BY part, o) AS places FROM places GROUP BY read_id, component"  # fmt: skip
    return _with("cores", "weights", **how, more=f"""cut AS (SELECT read_id, component, a, b, place FROM cores WHERE a = 0 OR place > a + {k - 2}),
spans AS (SELECT read_id, component, any_value(a) AS a, any_value(b) AS b, min(place) AS f, max(place) AS l FROM cut GROUP BY read_id, component),
back AS (SELECT s.*, p, length(seq) AS n FROM spans s JOIN ps USING (read_id)),
front AS (
  SELECT read_id, component, a, b, n, place, 1 AS part, place AS o FROM cut JOIN back USING (read_id, component, a, b)
  UNION ALL SELECT read_id, component, a, b, n, f - 1, 0, 0 FROM back WHERE a > 0 AND f > 0 AND (p[f] < 0.99 OR p[f] <= p[f + 1])
  UNION ALL SELECT read_id, component, a, b, n, place, 2, -place FROM (SELECT read_id, component, a, b, n, unnest(range(0, f)) AS place FROM back WHERE a = 0)),
places AS (
  SELECT read_id, component, part, place, o FROM front WHERE b + {k} >= n OR place < b + 1
  UNION ALL SELECT read_id, component, 3, place, place FROM (SELECT read_id, component, unnest(range(l + 1, n)) AS place FROM back WHERE b + {k} >= n))""") + "SELECT comps.read_id, comps.component, coalesce(string_agg(CAST(place AS VARCHAR), ',' ORDER BY part, o), '') AS places FROM comps LEFT JOIN places USING (read_id, component) GROUP BY comps.read_id, comps.component"  # fmt: skip


def _single_edits_sql() -> str:
    """Every edit of one base that makes all windows of a read trusted, tried one by one.

    The likeliest one counts if no other comes near a tenth of it; first among
    the chopped region's places, then, if that has another size, among the whole region's.
    """
    k = _K
    prior = "CASE WHEN {0} IN ('A', 'T') THEN pa ELSE 0.5 - pa END"
    return _with("comps", more=f"""chopped AS ({_region_sql(True)}), whole AS ({_region_sql(False)}),
one AS (SELECT read_id, any_value(a) AS a, any_value(b) AS b FROM comps GROUP BY read_id HAVING count(*) = 1 AND any_value(b) <= any_value(a) + {k - 1}),
options AS (
  SELECT read_id, 1 AS attempt, string_split(places, ',') AS ps FROM chopped WHERE places != '' UNION ALL SELECT read_id, 2, string_split(places, ',') FROM whole),
sizes AS (SELECT read_id, coalesce(max(len(ps)) FILTER (WHERE attempt = 1), 0) != max(len(ps)) FILTER (WHERE attempt = 2) AS again FROM options GROUP BY read_id),
places AS (
  SELECT o.read_id, attempt, place, a, b, seq, qual FROM (SELECT read_id, attempt, CAST(unnest(ps) AS BIGINT) AS place FROM options) o JOIN one USING (read_id) JOIN reads USING (read_id)
  WHERE place BETWEEN b AND a + {k - 1} AND length(seq) >= 30 AND qual NOT LIKE '%#%'),
edits AS (
  SELECT read_id, attempt, place, base, substring(seq, CAST(place AS INT) + 1, 1) AS old, substring(qual, CAST(place AS INT) + 1, 1) AS ch, substring(seq, 1, CAST(place AS INT)) || base || substring(seq, CAST(place AS INT) + 2, 60) AS seq
  FROM places, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) WHERE substring(seq, CAST(place AS INT) + 1, 1) != base),
tests AS (SELECT *, substring(seq, CAST(pos AS INT) + 1, {k}) AS f FROM (SELECT *, unnest(range(greatest(place - {k - 1}, 0), least(place, length(seq) - {k}) + 1)) AS pos FROM edits)),
fits AS (
  SELECT t.read_id, attempt, place, base, any_value(old) AS old, any_value(ch) AS ch FROM tests t LEFT JOIN good g ON g.kmer = least(f, reverse(translate(f, 'ACGT', 'TGCA'))) AND f NOT LIKE '%N%'
  GROUP BY t.read_id, attempt, place, base HAVING bool_and(g.kmer IS NOT NULL)),
likes AS (
  SELECT fits.*, CASE WHEN old = 'N' THEN 3 * {prior.format('base')} ELSE (1 - p) / (p * {prior.format('old')}) / 3 * {prior.format('base')} END AS l
  FROM (SELECT *, {_PROBABILITIES}[ascii(ch) - 32] AS p FROM fits) fits, (SELECT sum({_AT}) / CAST(sum({k}) AS DOUBLE) / 2 AS pa FROM good)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY read_id, attempt ORDER BY l DESC, place, base) AS r, lead(l) OVER (PARTITION BY read_id, attempt ORDER BY l DESC, place, base) AS l2 FROM likes),
found AS (SELECT read_id, min(attempt) AS attempt FROM ranked JOIN sizes USING (read_id) WHERE r = 1 AND l >= 1e-6 AND (l2 IS NULL OR l2 < 0.1 * l) AND (attempt = 1 OR again) GROUP BY read_id)""") + """SELECT read_id, CAST(place AS BIGINT) AS place, base FROM ranked JOIN found USING (read_id, attempt) WHERE r = 1 AND (old = 'N' OR ch = '(')"""  # fmt: skip


def _doubled() -> dict:
    """For _with(): the trusted k-mers of all reads, and in the place of `reads` those with an error, with a second one."""
    first = [s.replace(f"{a} AS (", f"{a}0 AS (", 1).replace(f"FROM {b}", f"FROM {b}0") for s, a, b in ((_STEPS["windows"], "w", "reads"), (_STEPS["kmers"], "c", "w"))]
    counts = _STEPS["counts"].replace("FROM c ", "FROM c0 ")
    one = "CAST((error_at + CASE WHEN read_id % 2 = 0 THEN 30 ELSE 20 END) % 60 AS INT)"
    reads = f"""reads AS MATERIALIZED (
  SELECT read_id, substring(seq, 1, o) || translate(substring(seq, o + 1, 1), 'ACGT', 'CGTA') || substring(seq, o + 2, 60) AS seq, substring(qual, 1, o) || '(' || substring(qual, o + 2, 60) AS qual
  FROM (SELECT *, {one} AS o FROM reads0 WHERE error_at >= 0 AND length(seq) = 60))"""
    base = [duckdb_ctes().strip().replace("reads AS MATERIALIZED", "reads0 AS MATERIALIZED"), *first, counts, _STEPS["good"], reads]
    return {"base": ",\n".join(base), "given": ("counts", "good")}


#: The likelihood of a base in place of `old` of the right probability p: the model gives half, three and two tenths to the bases after it.
_LIKELY = """(1 - p) / (p * CASE WHEN old IN ('A', 'T') THEN pa ELSE 0.5 - pa END) * CASE (strpos('ACGT', old) - strpos('ACGT', base) + 4) % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END
    * CASE WHEN base IN ('A', 'T') THEN pa ELSE 0.5 - pa END"""
_PA = f"(SELECT sum({_AT}) / CAST(sum({_K}) AS DOUBLE) / 2 AS pa FROM good)"


def _component_edits_sql() -> str:
    """The likeliest edit of each of a read's two components, tried one by one, as for single edits."""
    k, how = _K, _doubled()
    return _with("comps", **how, more=f"""chopped AS ({_region_sql(True, **how)}), whole AS ({_region_sql(False, **how)}),
two AS (SELECT read_id, component, a, b FROM comps WHERE read_id IN (SELECT read_id FROM comps GROUP BY read_id HAVING count(*) = 2) AND b <= a + {k - 1}),
options AS (
  SELECT read_id, component, 1 AS attempt, string_split(places, ',') AS ps FROM chopped WHERE places != '' UNION ALL SELECT read_id, component, 2, string_split(places, ',') FROM whole),
sizes AS (SELECT read_id, component, coalesce(max(len(ps)) FILTER (WHERE attempt = 1), 0) != max(len(ps)) FILTER (WHERE attempt = 2) AS again FROM options GROUP BY read_id, component),
places AS (
  SELECT o.read_id, o.component, attempt, place, seq, qual FROM (SELECT read_id, component, attempt, CAST(unnest(ps) AS INT) AS place FROM options) o JOIN two USING (read_id, component) JOIN reads USING (read_id)
  WHERE place BETWEEN b AND a + {k - 1}),
edits AS (
  SELECT read_id, component, attempt, place, base, substring(seq, place + 1, 1) AS old, substring(qual, place + 1, 1) AS ch, substring(seq, 1, place) || base || substring(seq, place + 2, 60) AS seq
  FROM places, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) WHERE substring(seq, place + 1, 1) != base),
tests AS (SELECT *, substring(seq, CAST(pos AS INT) + 1, {k}) AS f FROM (SELECT *, unnest(range(greatest(place - {k - 1}, 0), least(place, length(seq) - {k}) + 1)) AS pos FROM edits)),
fits AS (
  SELECT t.read_id, component, attempt, place, base, any_value(old) AS old, any_value(ch) AS ch FROM tests t LEFT JOIN good g ON g.kmer = least(f, reverse(translate(f, 'ACGT', 'TGCA')))
  GROUP BY t.read_id, component, attempt, place, base HAVING bool_and(g.kmer IS NOT NULL)),
likes AS (SELECT f.*, {_LIKELY} AS l FROM (SELECT *, {_PROBABILITIES}[ascii(ch) - 32] AS p FROM fits) f, {_PA}),
ranked AS (
  SELECT *, row_number() OVER o AS r, lead(l) OVER o AS l2 FROM likes WINDOW o AS (PARTITION BY read_id, component, attempt ORDER BY l DESC, place, base)),
found AS (
  SELECT read_id, component, min(attempt) AS attempt FROM ranked JOIN sizes USING (read_id, component) WHERE r = 1 AND l >= 1e-6 AND (l2 IS NULL OR l2 < 0.1 * l) AND (attempt = 1 OR again) GROUP BY read_id, component),
best AS (SELECT read_id, place, base FROM ranked JOIN found USING (read_id, component, attempt) WHERE r = 1 AND ch = '(')""") + """SELECT read_id, CAST(place AS BIGINT) AS place, base FROM best WHERE read_id IN (SELECT read_id FROM best GROUP BY read_id HAVING count(*) = 2)"""  # fmt: skip


def _paired_edits_sql() -> str:
    """The likeliest two edits of both doubtful bases of a read whose one component no single edit can reach."""
    k, how = _K, _doubled()
    return _with("comps", **how, more=f"""chopped AS ({_region_sql(True, **how)}), whole AS ({_region_sql(False, **how)}),
wide AS (SELECT read_id, any_value(a) AS a, any_value(b) AS b FROM comps GROUP BY read_id HAVING count(*) = 1 AND any_value(b) > any_value(a) + {k - 1}),
doubt AS (SELECT read_id, seq, strpos(qual, '(') - 1 AS p1, 60 - strpos(reverse(qual), '(') AS p2 FROM reads JOIN wide USING (read_id)),
regions AS (SELECT read_id, 1 AS attempt, ',' || places || ',' AS ps FROM chopped UNION ALL SELECT read_id, 2, ',' || places || ',' FROM whole),
tried AS (SELECT d.*, min(attempt) AS attempt FROM doubt d JOIN regions USING (read_id) WHERE contains(ps, ',' || p1 || ',') AND contains(ps, ',' || p2 || ',') GROUP BY ALL),
edits AS (
  SELECT read_id, p1, p2, x.base AS b1, y.base AS b2, substring(seq, CAST(p1 AS INT) + 1, 1) AS o1, substring(seq, CAST(p2 AS INT) + 1, 1) AS o2,
         substring(seq, 1, CAST(p1 AS INT)) || x.base || substring(seq, CAST(p1 AS INT) + 2, CAST(p2 - p1 - 1 AS INT)) || y.base || substring(seq, CAST(p2 AS INT) + 2, 60) AS seq
  FROM tried, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) x, (SELECT unnest(['A', 'C', 'G', 'T']) AS base) y),
tests AS (SELECT *, substring(seq, CAST(pos AS INT) + 1, {k}) AS f FROM (SELECT *, unnest(range(0, length(seq) - {k - 1})) AS pos FROM edits WHERE b1 != o1 AND b2 != o2)),
fits AS (
  SELECT t.read_id, p1, p2, b1, b2, any_value(o1) AS o1, any_value(o2) AS o2 FROM tests t LEFT JOIN good g ON g.kmer = least(f, reverse(translate(f, 'ACGT', 'TGCA')))
  GROUP BY t.read_id, p1, p2, b1, b2 HAVING bool_and(g.kmer IS NOT NULL)),
likes AS (
  SELECT fits.*, ({_LIKELY.replace("old", "o1").replace("base", "b1")}) * ({_LIKELY.replace("old", "o2").replace("base", "b2")}) AS l FROM fits, (SELECT {_PROBABILITIES}[8] AS p), {_PA}),
ranked AS (SELECT *, row_number() OVER o AS r, lead(l) OVER o AS l2 FROM likes WINDOW o AS (PARTITION BY read_id ORDER BY l DESC, b1, b2)),
best AS (SELECT * FROM ranked WHERE r = 1 AND (l2 IS NULL OR l2 < 0.1 * l))""") + """SELECT read_id, CAST(p1 AS BIGINT) AS place, b1 AS base FROM best UNION ALL SELECT read_id, CAST(p2 AS BIGINT), b2 FROM best"""  # fmt: skip


#: The peak m of integer and of weighted counts: of the bins behind the place where the histogram first stops falling, the first of the highest.
_PEAK = """dense AS (SELECT s.cov, coalesce(num, 0) AS num FROM (SELECT unnest(range(1, (SELECT max(cov) FROM h) + 1)) AS cov) s LEFT JOIN h ON h.cov = s.cov),
steps AS (SELECT cov, num, num >= lag(num) OVER (ORDER BY cov) AS up FROM dense),
top AS (SELECT coalesce((SELECT cov FROM dense WHERE cov >= (SELECT min(cov) FROM steps WHERE up) ORDER BY num DESC, cov LIMIT 1), 1) AS m)"""
_INT_PEAK = "h AS (SELECT n AS cov, count(*) AS num FROM counts GROUP BY n),\n" + _PEAK
_Q_PEAK = "h AS (SELECT greatest(CAST(ceil(q / CAST(1000000 AS DOUBLE)) AS BIGINT), 1) AS cov, count(*) AS num FROM fixed GROUP BY 1),\n" + _PEAK


def _fixed_model_sql() -> str:
    return _with("counts", more=f"""{_INT_PEAK}, covs AS (SELECT unnest(range(1, 41)) AS cov),
g AS (SELECT cov, {_GENUINE} AS genuine FROM covs, top, (SELECT unnest(range(1, 31)) AS j) GROUP BY cov),
r AS (SELECT cov, 0.6 * (power(cov, -2.0) - power(cov + 1, -2.0)) / genuine < 200 AS below FROM g)
SELECT CAST(cov AS BIGINT) AS cov, below, (SELECT CAST(min(cov) AS BIGINT) FROM r WHERE below) AS cutoff FROM r""")


#: Where the histogram h first stops falling.
_TURN = "d AS (SELECT cov, num, num >= lag(num) OVER (ORDER BY cov) AS up FROM h), t AS (SELECT min(cov) AS turn FROM d WHERE up)"
_GENUINE = "sum(power(j, -3.0) / {z!r} * 0.4 * exp(-power(cov - j * m, 2) / (2 * j * m)) / sqrt(2 * pi() * j * m))".format(z=zeta(3.0))
_CLASSES = "count(*) FILTER (WHERE status {})"

ORACLE_SQL = {
    "reads_scan": _with("reads") + "SELECT read_id, contig_id, truth, seq, qual FROM reads",
    "quality_offset_guess": _with("reads") + "SELECT CAST(CASE WHEN min(ascii(ch)) < 64 THEN 33 ELSE 64 END AS INT) AS quality_offset FROM (SELECT unnest(string_split(qual, '')) AS ch FROM reads WHERE read_id < 1000)",
    "scan_summary": _with("counts") + "SELECT count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS n_bases, CAST(sum(length(seq) - length(replace(seq, 'N', ''))) AS BIGINT) AS n_unknown, (SELECT count(*) FROM counts) AS n_kmers FROM reads",
    "kmer_count_int": _with("counts") + "SELECT kmer, n FROM counts",
    "kmer_count_min": _with("counts") + "SELECT kmer, n FROM counts WHERE n > 2",
    "kmer_count_one_strand": _with("windows") + "SELECT f AS kmer, count(*) AS n FROM w WHERE f NOT LIKE '%N%' GROUP BY f",
    "qmer_count_fixed": _with("fixed") + "SELECT kmer, q FROM fixed",
    "qmer_count_saturated": _with("weights") + "SELECT kmer, CAST(least(sum(CAST(floor(weight * 500) AS BIGINT)), 8191) AS BIGINT) AS q FROM q WHERE weight > 0.005 GROUP BY kmer",
    "qmer_count_double": _with("weights") + "SELECT kmer, CAST(round(sum(weight) * 1000) AS BIGINT) AS q_milli FROM q WHERE weight > 0.0001 GROUP BY kmer HAVING sum(weight) >= 1.0",
    "reduce_kmers": _with("counts") + "SELECT kmer, n FROM counts",
    "reduce_qmers_fixed": _with("fixed") + "SELECT kmer, q FROM fixed",
    "kmer_pack": _with("counts") + f"SELECT kmer, CAST({_PACKED.format('kmer')} AS BIGINT) AS packed, CAST({_PACKED.format("reverse(translate(kmer, 'ACGT', 'TGCA'))")} AS BIGINT) AS packed_rc, kmer AS unpacked FROM counts",
    "at_count_bins": _with("counts") + f"SELECT CAST({_AT} AS BIGINT) AS \"at\", count(*) AS num FROM counts GROUP BY {_AT}",
    "coverage_hist": _with("counts") + "SELECT n AS cov, count(*) AS num FROM counts GROUP BY n",
    "hist_bin10": _with("fixed", more="""hq AS (SELECT greatest(CAST(ceil(q / CAST(1000000 AS DOUBLE)) AS BIGINT), 1) AS cov, count(*) AS num FROM fixed GROUP BY 1),
h AS (SELECT s.cov, coalesce(num, 0) AS num FROM (SELECT unnest(range(1, (SELECT max(cov) FROM hq) + 1)) AS cov) s LEFT JOIN hq ON hq.cov = s.cov), """ + _TURN + """,
p AS (SELECT cov AS peak FROM h WHERE cov >= (SELECT turn FROM t) ORDER BY num DESC, cov LIMIT 1),
f AS (SELECT greatest((q + 99999) // 100000, 1) AS bin, count(*) AS num FROM fixed WHERE q < (SELECT peak FROM p) * 2500000 GROUP BY 1)""") + "SELECT CAST(b.bin AS BIGINT) AS bin, coalesce(num, 0) AS num FROM (SELECT unnest(range(1, (SELECT peak FROM p) * 25 + 1)) AS bin) b LEFT JOIN f ON f.bin = b.bin",
    "first_valley_peak": _with("counts", more="""x AS (SELECT n AS cov, count(*) AS num FROM counts GROUP BY n),
h AS (SELECT s.cov, coalesce(num, 0) AS num FROM (SELECT unnest(range(1, (SELECT max(cov) FROM x) + 1)) AS cov) s LEFT JOIN x ON x.cov = s.cov), """ + _TURN) + "SELECT CAST(turn - 1 AS BIGINT) AS valley, CAST((SELECT cov FROM h WHERE cov >= turn ORDER BY num DESC, cov LIMIT 1) AS BIGINT) AS peak FROM t",
    "count_sample": _with("counts") + f"SELECT kmer, n FROM counts ORDER BY {_DRAW}, kmer LIMIT 3000",
    "stratified_sample": _with("counts", more=f"r AS (SELECT {_AT} AS a, kmer, n, row_number() OVER (PARTITION BY {_AT} ORDER BY {_DRAW}, kmer) AS r FROM counts)") + "SELECT CAST(a AS BIGINT) AS \"at\", kmer, n FROM r WHERE r <= 200",
    "trusted_scalar": _with("good") + "SELECT kmer, n FROM good",
    "trusted_at_cutoff": _with("counts") + f"SELECT kmer, n FROM counts WHERE n >= 3 + ({_AT}) % 3",
    "trusted_both_strands": _with("good") + "SELECT kmer FROM good UNION SELECT reverse(translate(kmer, 'ACGT', 'TGCA')) FROM good",
    "at_gc_prior": _with("good") + f"SELECT CAST(sum({_AT}) AS BIGINT) AS \"at\", CAST(sum({_K} - ({_AT})) AS BIGINT) AS gc FROM good",
    "quick_trim": _with("reads", more=_trim(_RAW, 3)) + "SELECT read_id, CAST(trim_len AS BIGINT) AS trim_len FROM trims",
    "trim_clamped": _with("reads", more=_trim(f"greatest({_RAW}, 1)", 9)) + "SELECT read_id, CAST(trim_len AS BIGINT) AS trim_len FROM trims",
    "trim_program": _with("reads", more=_trim(f"greatest({_RAW}, 1)", 3)) + "SELECT read_id, substring(seq, 1, CAST(trim_len AS INT)) AS seq, substring(qual, 1, CAST(trim_len AS INT)) AS qual, CASE WHEN trim_len < 30 THEN 'error' WHEN trim_len < n THEN 'trimmed' ELSE 'kept' END AS status FROM reads JOIN trims USING (read_id)",
    "untrusted_positions": _with("bad") + "SELECT read_id, CAST(pos AS BIGINT) AS pos FROM bad",
    "untrusted_components": _with("comps") + 'SELECT read_id, component, CAST(a AS BIGINT) AS "first", CAST(b AS BIGINT) AS "last", num FROM comps',
    "component_intersect": _with("comps") + f"SELECT read_id, component, CASE WHEN b <= a + {_K - 1} THEN array_to_string(range(b, a + {_K}), ',') ELSE '' END AS places FROM comps",
    "component_union": _with("cores") + f"SELECT read_id, component, {_PLACES} AS places FROM covered GROUP BY read_id, component",
    "error_region": _region_sql(False),
    "error_region_chop": _region_sql(True),
    "single_edits": _single_edits_sql(),
    "component_edits": _component_edits_sql(),
    "paired_edits": _paired_edits_sql(),
    "int_cutoff_fixed_params": _fixed_model_sql(),
    "int_likelihood_fixed_params": _with("counts", more=f"""{_INT_PEAK},
g AS (SELECT cov, any_value(num) AS num, {_GENUINE} AS genuine FROM h, top, (SELECT unnest(range(1, 31)) AS j) WHERE cov < 37.5 * m GROUP BY cov)""") + "SELECT CAST(round(-sum(num * ln(0.6 * (power(cov, -2.0) - power(cov + 1, -2.0)) + genuine))) AS BIGINT) AS nll FROM g",
    "q_likelihood_fixed_params": _with("fixed", more=f"""{_Q_PEAK}, milli AS (SELECT greatest(q // 1000, 1) / 1000 AS cov, count(*) AS num FROM fixed GROUP BY 1),
g AS (SELECT cov, any_value(num) AS num, {_GENUINE} AS genuine FROM milli, top, (SELECT unnest(range(1, 31)) AS j) WHERE cov < 37.5 * m GROUP BY cov)""") + "SELECT CAST(round(-sum(num * ln(0.6 * (exp(-(ceil(cov) - 1) / 0.9) - exp(-ceil(cov) / 0.9)) + genuine))) AS BIGINT) AS nll FROM g",
    "q_cutoff_fixed_params": _with("fixed", more=f"""{_Q_PEAK}, x AS (SELECT centi, centi / 100 AS cov FROM (SELECT unnest(range(0, 2501)) AS centi)),
g AS (SELECT centi, cov, {_GENUINE} AS genuine FROM x, top, (SELECT unnest(range(1, 31)) AS j) GROUP BY centi, cov),
r AS (SELECT centi, 0.6 * exp(-cov / 0.9) / 0.9 / genuine AS ratio FROM g)""") + """SELECT CAST(centi AS BIGINT) AS centi, ratio < 200 AS below, (SELECT CAST(centi AS BIGINT) FROM r ORDER BY abs(ratio - 200), centi LIMIT 1) AS cutoff FROM r WHERE centi > 0""",
    "error_model_counts": _with("reads", more=_PLANTED) + "SELECT CAST(q AS BIGINT) AS q, actual, observed, count(*) AS n FROM planted WHERE observed != 'N' GROUP BY q, actual, observed",
    "error_model_kernel": _with("reads", more=_PLANTED + f""",
n AS (SELECT 7 + read_id % 3 * 5 AS qr, actual, observed, count(*) AS n FROM planted WHERE observed != 'N' GROUP BY 1, 2, 3),
qs AS (SELECT unnest(range(1, {MAX_QUALITY})) AS q), bs AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base),
x AS (SELECT q, actual, observed, n * {_KERNEL}[abs(qr - q) + 1] AS w FROM n, qs),
part AS (SELECT q, actual, observed, sum(w) AS part FROM x GROUP BY q, actual, observed), whole AS (SELECT q, actual, sum(w) AS whole FROM x GROUP BY q, actual)""") + """SELECT CAST(g.q AS BIGINT) AS q, g.actual, g.observed, CASE WHEN coalesce(whole, 0) = 0 THEN CAST(1 AS DOUBLE) / 3 ELSE CAST(coalesce(part, 0) AS DOUBLE) / CAST(whole AS DOUBLE) END AS p
FROM (SELECT q, a.base AS actual, o.base AS observed FROM qs, bs a, bs o WHERE a.base != o.base) g
LEFT JOIN part ON part.q = g.q AND part.actual = g.actual AND part.observed = g.observed LEFT JOIN whole ON whole.q = g.q AND whole.actual = g.actual""",
    "substitution_matrix": _with("reads", more=_CHANGES) + "SELECT new_nt, old_nt, count(*) AS num FROM ch WHERE old_nt != 'N' GROUP BY new_nt, old_nt",
    "substitution_by_position": _with("reads", more=_CHANGES) + "SELECT CAST(pos AS BIGINT) AS pos, count(*) AS num FROM ch GROUP BY pos",
    "correction_report": _with("reads", more=_CHANGES + """,
fixed AS (SELECT read_id, length(seq) AS n, CASE WHEN read_id % 7 = 0 THEN least(54, length(truth)) ELSE length(truth) END AS m FROM reads WHERE read_id % 4 != 3),
cc AS (SELECT ch.read_id, n - m AS cut FROM ch JOIN fixed USING (read_id) WHERE pos <= m)""") + """SELECT (SELECT count(*) FROM reads) AS total, (SELECT count(*) FROM reads WHERE read_id % 4 = 3) AS tossed,
(SELECT count(DISTINCT read_id) FROM cc) AS corrected, (SELECT count(*) FROM cc) AS corrected_bp, (SELECT CAST(coalesce(sum(cut), 0) AS BIGINT) FROM (SELECT DISTINCT read_id, cut FROM cc)) AS trimmed_bp""",
    "trims_by_position": _with("reads", more=_CHANGES + """,
fixed AS (SELECT read_id, length(seq) AS n, CASE WHEN read_id % 7 = 0 THEN least(54, length(truth)) ELSE length(truth) END AS m FROM reads WHERE read_id % 4 != 3),
cut AS (SELECT DISTINCT ch.read_id, n, m FROM ch JOIN fixed USING (read_id) WHERE pos <= m AND m < n)""") + "SELECT CAST(pos AS BIGINT) AS pos, count(*) AS num FROM (SELECT unnest(range(m + 1, n + 1)) AS pos FROM cut) GROUP BY pos",
    "pair_routing": _with("reads", more="m AS (SELECT read_id AS pair_id, read_id % 5 != 0 AND seq NOT LIKE '%N%' AS ok1, read_id % 3 != 0 AS ok2 FROM reads)") + "SELECT pair_id, ok1, ok2, CASE WHEN ok1 AND ok2 THEN 'pair' WHEN ok1 THEN 'single1_err2' WHEN ok2 THEN 'err1_single2' ELSE 'err' END AS route FROM m",
    "run_stats": _with("reads", more=_FOUND) + f"""SELECT {_CLASSES.format("= 'validated'")} AS validated, {_CLASSES.format("IN ('corrected', 'corrected_trimmed')")} AS corrected,
{_CLASSES.format("IN ('trimmed', 'corrected_trimmed')")} AS trimmed, {_CLASSES.format("= 'trimmed'")} AS trimmed_only, {_CLASSES.format("= 'removed'")} AS removed FROM marked""",
    "output_rows": _with("reads", more=_FOUND) + """SELECT read_id, status,
  CASE WHEN status = 'removed' THEN 'r' || read_id || ' error' ELSE 'r' || read_id || CASE WHEN changed THEN ' correct' ELSE '' END || CASE WHEN cut > 0 THEN ' trim=' || cut ELSE '' END END AS out_header,
  CASE WHEN status = 'removed' THEN seq ELSE cor END AS out_seq,
  CASE WHEN status = 'removed' THEN qual ELSE array_to_string(list_transform(range(1, length(cor) + 1), lambda i: CASE WHEN substring(cor, i, 1) != substring(seq, i, 1) THEN '#' ELSE substring(qual, i, 1) END), '') END AS out_qual FROM marked""",
    "correction_log": _with("reads", more=_FOUND + """,
lines AS (SELECT read_id, seq, qual, cor, unnest(range(1, length(cor) + 1)) AS pos FROM marked WHERE status != 'removed')""") + """SELECT read_id, CAST(ascii(substring(qual, CAST(pos AS INT), 1)) - 33 AS BIGINT) AS q, CAST(pos AS BIGINT) AS pos, substring(cor, CAST(pos AS INT), 1) AS new_nt, substring(seq, CAST(pos AS INT), 1) AS old_nt
FROM lines WHERE substring(cor, CAST(pos AS INT), 1) != substring(seq, CAST(pos AS INT), 1)""",
}
