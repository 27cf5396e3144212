"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The SQL is generated from the same fixed values the Spark side uses
(patterns, vocabulary, weights), so both engines evaluate the same rules:
regexes are written once with an explicit whitespace class both java.util.regex
and RE2 read the same way, doubles are rounded half-to-even after scaling,
and double literals carry an exponent (``55e-2``) so DuckDB does not treat
them as DECIMAL.
"""

from __future__ import annotations

import math
from html.entities import html5

from shortlist.functions import scoring as sc
from shortlist.functions import text as tx
from shortlist.functions.scoring import Criteria
from shortlist.operators import metrics as mt
from shortlist.operators import embed as em
from shortlist.plans import catalog as cat
from shortlist.plans.fixtures import CRITERIA_SQL, RAW_TEXT_SQL, VOCABULARY_WORD
from shortlist.sources import extractors as ex
from shortlist.sources.extractors import HTML_COMMENT, HTML_DROP_BLOCKS, HTML_TAG

WS = tx.WS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


def str_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


WS_SQL = "(" + " || ".join(f"chr({ord(ch)})" for ch in tx.WS_CHARS) + ")"


def strip(e: str) -> str:
    return f"trim({e}, {WS_SQL})"


def clean(e: str) -> str:
    inner = f"regexp_replace({e}, {lit(f'[{WS}]+')}, ' ', 'g')"
    return f"trim(regexp_replace({inner}, {lit(r'[^\x20-\x7E]')}, ' ', 'g'))"


def email(e: str) -> str:
    return f"lower(regexp_extract({e}, {lit(tx.EMAIL_PATTERN)}, 0))"


def phone_candidate(e: str) -> str:
    return (f"regexp_replace(regexp_extract({e}, {lit(tx.PHONE_PATTERN)}, 1), "
            f"{lit(tx.PHONE_STRIP_PATTERN)}, '', 'g')")


def phone_from_candidate(c: str) -> str:
    return (f"CASE WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) "
            f"BETWEEN {tx.PHONE_MIN_DIGITS} AND {tx.PHONE_MAX_DIGITS} THEN {c} ELSE '' END")


def experience(e: str) -> str:
    parts = [f"regexp_extract_all({e}, {lit(p)}, 1)" for p in tx.EXPERIENCE_PATTERNS]
    return (f"coalesce(list_max(list_transform({' || '.join(parts)}, lambda x: TRY_CAST(x AS BIGINT))), "
            f"CAST(0 AS BIGINT))")


def skills(e: str) -> str:
    vocab = str_list(tx.sorted_vocab())
    return f"array_to_string(list_filter({vocab}, lambda s: contains(lower({e}), s)), ', ')"


def long_enough(e: str) -> str:
    return f"({e} IS NOT NULL AND length({strip(e)}) >= {tx.MIN_TEXT_CHARS})"


def cand(skills_list: str = "Skills_List") -> str:
    return (f"list_filter(list_transform(string_split({skills_list}, ','), lambda x: lower({strip('x')})), "
            f"lambda x: x <> '')")


def round_even(e: str, decimals: int) -> str:
    scale = dbl(10.0 ** decimals)
    return f"(round_even(({e}) * {scale}, 0) / {scale})"


RAW = f"raw AS (SELECT doc_id, source, {RAW_TEXT_SQL} AS raw_text FROM documents)"

RES = f"""res AS (
  SELECT doc_id, printf('R%04d', doc_id) AS Resume_ID, coalesce(source, '') AS Source_File,
         {clean('raw_text')} AS Resume_Text, {email('raw_text')} AS Email,
         {phone_from_candidate('_pc')} AS Phone,
         {experience('raw_text')} AS Exp_Years, {skills('raw_text')} AS Skills_List
  FROM (SELECT *, {phone_candidate('raw_text')} AS _pc FROM raw)
  WHERE {long_enough('raw_text')})"""


def sem_cte(name: str = "sem", vec_id: int = cat.QUERY_VECTOR_ID, key: str = "doc_id") -> str:
    return f"""{name} AS (
  SELECT e.vec_id AS {key},
         coalesce(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0e0)
           AS Semantic_Score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {int(vec_id)}) q)"""


def _buckets(text: str, key: str, source: str) -> str:
    """(key, b, c): tokens per bucket."""
    return f"""SELECT {key}, ('0x' || substr(md5(t), 1, {em.HASH_DIGITS}))::BIGINT % {em.DEFAULT_DIM} AS b, count(*) AS c
       FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), {lit(em.TOKEN_PATTERN)})) AS t FROM {source})
       GROUP BY {key}, b"""


def vector_ctes() -> str:
    """Sparse document vectors dv (doc_id, b, x), squared norms nrm, bucket weights wgt."""
    return f"""tok AS ({_buckets('Resume_Text', 'doc_id', 'res')}),
n_docs AS (SELECT count(*) AS n FROM res),
wgt AS (SELECT b, length(bin(any_value(n) // count(*))) AS w FROM tok, n_docs GROUP BY b),
dv AS (SELECT doc_id, b, c * w AS x FROM tok JOIN wgt USING (b)),
nrm AS (SELECT doc_id, CAST(sum(x * x) AS DOUBLE) AS s FROM dv GROUP BY doc_id)"""


def described_cte(description: str, name: str = "sem") -> str:
    """Cosine of every document's vector with the job description's."""
    asked = f"(SELECT 0 AS k, {lit(description)} AS jd)"
    return f"""{name}_v AS (SELECT b, c * coalesce(w, length(bin(n))) AS y
                 FROM ({_buckets('jd', 'k', asked)}) LEFT JOIN wgt USING (b), n_docs),
{name} AS (SELECT res.doc_id, coalesce(any_value(d) / sqrt(any_value(s) * (SELECT CAST(sum(y * y) AS DOUBLE) FROM {name}_v)), 0e0)
                   AS Semantic_Score
  FROM res LEFT JOIN nrm USING (doc_id)
       LEFT JOIN (SELECT doc_id, CAST(sum(x * y) AS DOUBLE) AS d FROM dv JOIN {name}_v USING (b) GROUP BY doc_id) USING (doc_id)
  GROUP BY res.doc_id)"""


def passes(c: Criteria, cand_col: str = "cand") -> str:
    mand = c.mandatory_set
    if not mand:
        return "true"
    return f"(len(list_filter({str_list(mand)}, lambda m: NOT list_contains({cand_col}, m))) = 0)"


def skill_score(c: Criteria, cand_col: str = "cand") -> str:
    req = c.required_set
    share = "1e0" if not req else \
        f"(len(list_filter({str_list(req)}, lambda r: list_contains({cand_col}, r))) / {dbl(len(req))})"
    return f"CASE WHEN {passes(c, cand_col)} THEN {share} ELSE 0e0 END"


def exp_score(c: Criteria) -> str:
    m = int(c.min_exp)
    return f"CASE WHEN Exp_Years < {m} THEN 0e0 ELSE least(1e0, (Exp_Years - {m} + 1) / 10e0) END"


def final(sem: str = "Semantic_Score", exp: str = "Exp_Score", skill: str = "Skill_Score") -> str:
    total = (f"{dbl(sc.WEIGHT_SEMANTIC)} * {sem} + {dbl(sc.WEIGHT_EXPERIENCE)} * {exp} "
             f"+ {dbl(sc.WEIGHT_SKILLS)} * {skill}")
    return round_even(total, sc.SCORE_DECIMALS)


def reason(c: Criteria, sem: str = "Semantic_Score") -> str:
    sem_part = (f"CASE WHEN {sem} >= {dbl(sc.STRONG_SEMANTIC)} THEN {lit(sc.STRONG_PHRASE)} "
                f"WHEN {sem} >= {dbl(sc.MODERATE_SEMANTIC)} THEN {lit(sc.MODERATE_PHRASE)} END")
    exp_part = (f"CASE WHEN Exp_Years > 0 THEN CAST(Exp_Years AS VARCHAR) || "
                f"{lit(sc.EXPERIENCE_PHRASE.replace('{}', ''))} END")
    parts = [sem_part, exp_part]
    if c.required:
        rcand = f"list_transform(string_split(Skills_List, ','), lambda x: lower({strip('x')}))"
        matched = f"list_filter({str_list(c.required)}, lambda s: list_contains({rcand}, lower(s)))"
        prefix = sc.SKILLS_PHRASE.replace("{}", "")
        parts.append(f"CASE WHEN len({matched}) > 0 THEN {lit(prefix)} || "
                     f"array_to_string(({matched})[1:{sc.REASON_MAX_SKILLS}], ', ') END")
    arr = f"list_filter([{', '.join(parts)}], lambda p: p IS NOT NULL)"
    return (f"CASE WHEN len({arr}) > 0 THEN {lit(sc.REASON_PREFIX)} || array_to_string({arr}, "
            f"{lit(sc.REASON_JOIN)}) ELSE {lit(sc.BASELINE_REASON)} END")


def scored_ctes(c: Criteria = cat.CRITERIA, vec_id: int | None = None) -> str:
    """raw → res → sem → scored → thr → lab; by a stored vector if ``vec_id`` is given, else by the job description."""
    sem = f"{vector_ctes()},\n{described_cte(c.job_description)}" if vec_id is None else sem_cte("sem", vec_id)
    return f"""WITH {RAW},
{RES},
{sem},
sc1 AS (SELECT res.* EXCLUDE (Resume_Text), sem.Semantic_Score, {cand()} AS cand
        FROM res JOIN sem USING (doc_id)),
sc2 AS (SELECT *, {exp_score(c)} AS Exp_Score, {skill_score(c)} AS Skill_Score,
               {passes(c)} AS Passes_Mandatory FROM sc1),
scored AS (SELECT * EXCLUDE (cand), {final()} AS Final_Score,
                  (Exp_Years >= {int(c.min_exp)} AND Passes_Mandatory) AS Eligible,
                  {reason(c)} AS Reason FROM sc2),
thr AS (SELECT {round_even(f'quantile_cont(Final_Score, {sc.LOW_QUANTILE})', sc.THRESHOLD_DECIMALS)} AS low,
               {round_even(f'quantile_cont(Final_Score, {sc.HIGH_QUANTILE})', sc.THRESHOLD_DECIMALS)} AS high
        FROM scored),
lab AS (SELECT scored.*, CASE WHEN Final_Score >= high THEN 'High' WHEN Final_Score >= low THEN 'Medium'
                              ELSE 'Low' END AS Label FROM scored, thr)"""


RECORDS = ", ".join(["Resume_ID", "Source_File", "Email", "Phone", "Final_Score", "Semantic_Score",
                     "Exp_Years", "Skills_List", "Label", "Reason"])
ORDER = "Final_Score DESC, Resume_ID, Source_File"


def top_cte(n: int) -> str:
    return f"top AS (SELECT * FROM lab WHERE Eligible ORDER BY {ORDER} LIMIT {int(n)})"


def others_sql(n: int) -> str:
    return (f"SELECT row_number() OVER (ORDER BY Eligible DESC, {ORDER}) AS pos, {RECORDS} FROM lab WHERE NOT EXISTS (SELECT 1 FROM top t WHERE "
            f"t.Resume_ID = lab.Resume_ID AND t.Source_File = lab.Source_File)")


def histogram_sql(source: str, col: str, bins: int) -> str:
    def edge(i: str) -> str:
        return f"CASE WHEN {i} >= {bins} THEN hi ELSE CAST({i} AS DOUBLE) * ((hi - lo) / {dbl(bins)}) + lo END"
    return f""",
vc AS (SELECT {col} AS value, count(*) AS n FROM {source} WHERE {col} IS NOT NULL GROUP BY 1),
lim0 AS (SELECT CAST(min(value) AS DOUBLE) AS lo, CAST(max(value) AS DOUBLE) AS hi FROM vc),
lim AS (SELECT CASE WHEN lo = hi THEN lo - 0.5e0 ELSE lo END AS lo,
               CASE WHEN lo = hi THEN hi + 0.5e0 ELSE hi END AS hi FROM lim0),
g AS (SELECT n, CAST(value AS DOUBLE) AS x, lo, hi,
             CAST(least(greatest(floor((CAST(value AS DOUBLE) - lo) / (hi - lo) * {dbl(bins)}), 0), {bins - 1}) AS BIGINT) AS guess
      FROM vc, lim),
gb AS (SELECT n, CASE WHEN x < {edge('guess')} THEN guess - 1
                      WHEN x >= {edge('guess + 1')} AND guess <> {bins - 1} THEN guess + 1
                      ELSE guess END AS b FROM g),
per AS (SELECT b, sum(n) AS cnt FROM gb GROUP BY b)
SELECT CAST(r.range + 1 AS INTEGER) AS bin, {edge('r.range')} AS bin_lo, {edge('r.range + 1')} AS bin_hi,
       CAST(coalesce(per.cnt, 0) AS BIGINT) AS count
FROM range({bins}) r CROSS JOIN lim LEFT JOIN per ON per.b = r.range"""


def density_sql(source: str, col: str) -> str:
    pts = mt.DENSITY_POINTS
    return f""",
vc AS (SELECT CAST({col} AS DOUBLE) AS v, count(*) AS n FROM {source} WHERE {col} IS NOT NULL GROUP BY 1),
st AS (SELECT sum(n) AS cnt, min(v) AS lo, max(v) AS hi, sum(n * v) AS s1, sum(n * v * v) AS s2 FROM vc),
st2 AS (SELECT cnt, lo, hi,
               sqrt((s2 - s1 * s1 / cnt) / (cnt - 1)) * pow(CAST(cnt AS DOUBLE), -0.2e0) AS h,
               (hi - lo) / {dbl(mt.SCORE_BINS)} AS width FROM st),
grid AS (SELECT CAST(range AS INTEGER) AS point,
                CASE WHEN range = {pts - 1} THEN hi ELSE CAST(range AS DOUBLE) * ((hi - lo) / {dbl(pts - 1)}) + lo END AS x
         FROM range({pts}), st2),
zz AS (SELECT grid.point, grid.x, vc.n, (grid.x - vc.v) / st2.h AS z FROM grid, vc, st2
       WHERE st2.cnt >= 2 AND st2.h > 0)
SELECT point, {round_even('x', mt.DENSITY_DECIMALS)} AS x,
       {round_even(f'sum(n * exp(-0.5e0 * z * z)) * (max(st2.width) / (max(st2.h) * {dbl(math.sqrt(2.0 * math.pi))}))', mt.DENSITY_DECIMALS)} AS density
FROM zz, st2 GROUP BY point, x"""


def confusion_sql(source: str, actual: str, predicted: str, labels) -> str:
    names = [str(x) for x in labels]
    cols = ", ".join(
        f"count_if(CAST({actual} AS VARCHAR) = {lit(a)} AND CAST({predicted} AS VARCHAR) = {lit(p)}) AS c_{i}_{j}"
        for i, a in enumerate(names) for j, p in enumerate(names))
    rows = " UNION ALL ".join(
        f"SELECT {lit(a)} AS actual, " + ", ".join(f"c_{i}_{j} AS \"{p}\"" for j, p in enumerate(names)) + " FROM agg"
        for i, a in enumerate(names))
    return f""",
agg AS (SELECT {cols} FROM {source})
{rows}"""


def per_class_body(source: str, actual: str, predicted: str, labels) -> str:
    names = [str(x) for x in labels]
    a, p = f"CAST({actual} AS VARCHAR)", f"CAST({predicted} AS VARCHAR)"
    cols = ", ".join(
        f"count_if({a} = {lit(x)} AND {p} = {lit(x)}) AS tp_{i}, count_if({p} = {lit(x)}) AS pred_{i}, "
        f"count_if({a} = {lit(x)}) AS true_{i}" for i, x in enumerate(names))

    def ratio(num: str, den: str) -> str:
        return f"CASE WHEN {den} = 0 THEN 0e0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END"

    rows = " UNION ALL ".join(
        f"SELECT {i} AS row, {lit(x)} AS label, {ratio(f'tp_{i}', f'pred_{i}')} AS precision, "
        f"{ratio(f'tp_{i}', f'true_{i}')} AS recall, {ratio(f'2 * tp_{i}', f'true_{i} + pred_{i}')} AS f1, "
        f"true_{i} AS support FROM pcagg" for i, x in enumerate(names))
    return f""",
pcagg AS (SELECT {cols} FROM {source}),
per AS ({rows})"""


def per_class_sql(source: str, actual: str, predicted: str, labels) -> str:
    return per_class_body(source, actual, predicted, labels) + \
        "\nSELECT label, precision, recall, f1, support FROM per"


def metrics_sql(source: str, actual: str, predicted: str, labels) -> str:
    k = dbl(len(labels))
    names = [str(x) for x in labels]
    by_row = {c: " + ".join(f"(SELECT {c} FROM per WHERE row = {i})" for i in range(len(names)))
              for c in ("precision", "recall", "f1")}
    acc = (f"(SELECT coalesce(avg(CAST(CAST({actual} AS VARCHAR) = CAST({predicted} AS VARCHAR) AS DOUBLE)), 0e0) "
           f"FROM {source})")
    return per_class_body(source, actual, predicted, labels) + f"""
SELECT {round_even(acc, mt.METRIC_DECIMALS)} AS accuracy,
       {round_even(f"({by_row['precision']}) / {k}", mt.METRIC_DECIMALS)} AS macro_precision,
       {round_even(f"({by_row['recall']}) / {k}", mt.METRIC_DECIMALS)} AS macro_recall,
       {round_even(f"({by_row['f1']}) / {k}", mt.METRIC_DECIMALS)} AS macro_f1"""


def chars(s: str) -> str:
    """A string as DuckDB code points, so control characters need no quoting."""
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")"


def unescape(e: str) -> str:
    """Character references of ``e`` replaced; ``names`` is the table of names."""
    number = f"regexp_extract(p, {lit(ex.REFERENCE_NUMBER)}, 0)"
    code = (f"(CASE WHEN p[2] IN ('x', 'X') THEN CASE WHEN length(regexp_extract(p, {lit(ex.REFERENCE_HEX)}, 1)) <= 6 "
            f"THEN CAST('0x0' || regexp_extract(p, {lit(ex.REFERENCE_HEX)}, 1) AS BIGINT) ELSE {ex.LAST_CODE + 1} END "
            f"WHEN length(regexp_extract(p, {lit(ex.REFERENCE_DECIMAL)}, 1)) <= 7 "
            f"THEN CAST('0' || regexp_extract(p, {lit(ex.REFERENCE_DECIMAL)}, 1) AS BIGINT) ELSE {ex.LAST_CODE + 1} END)")
    nothing = " OR ".join([f"{code} & 65534 = 65534", *[f"{code} BETWEEN {a} AND {b}" for a, b in ex.NO_CHARACTER]])
    char = (f"CASE WHEN {code} = 0 OR {code} > {ex.LAST_CODE} OR {code} BETWEEN 55296 AND 57343 THEN chr({ord(ex.REPLACEMENT)}) "
            f"WHEN {code} BETWEEN 128 AND 159 THEN substr({chars(ex.WINDOWS_80)}, ({code} - 127)::INTEGER, 1) "
            f"WHEN {nothing} THEN '' ELSE chr({code}::INTEGER) END")
    name, legacy = (f"regexp_extract(p, {lit(x)}, 0)" for x in (ex.REFERENCE_NAME, ex.REFERENCE_LEGACY))
    piece = (f"CASE WHEN {number} <> '' THEN {char} || substr(p, length({number}) + 1) "
             f"WHEN names[{name}] IS NOT NULL THEN names[{name}] || substr(p, length({name}) + 1) "
             f"WHEN {legacy} <> '' THEN names[{legacy}] || substr(p, length({legacy}) + 1) ELSE '&' || p END")
    return (f"(CASE WHEN contains({e}, '&') THEN array_to_string(list_transform(string_split({e}, '&'), "
            f"lambda p, i: CASE WHEN i = 1 THEN p ELSE {piece} END), '') ELSE {e} END)")


def html_text_sql() -> str:
    stripped = f"regexp_replace(regexp_replace(regexp_replace(html, {lit(HTML_DROP_BLOCKS)}, ' ', 'g'), {lit(HTML_COMMENT)}, ' ', 'g'), {lit(HTML_TAG)}, ' ', 'g')"
    table = ", ".join(f"({lit(n)}, {chars(v)})" for n, v in html5.items())
    ws = lit(f"[{WS}]+")
    return f"""WITH t AS (SELECT map(list(n), list(v)) AS names FROM (VALUES {table}) v(n, v)),
s AS (SELECT page_id, {stripped} AS html FROM pages)
SELECT page_id, trim(regexp_replace({unescape('html')}, {ws}, ' ', 'g')) AS text FROM s, t"""


def _quality() -> str:
    return "WITH q AS (SELECT doc_id, quality AS actual, 1 - toxic AS predicted FROM labels)"


def _many_sql(stored: bool) -> str:
    ctes = [RAW, RES] if stored else [RAW, RES, vector_ctes()]
    selects = []
    for i, (c, vid) in enumerate(cat.MANY_QUERIES):
        ctes.append(sem_cte(f"sem{i}", vid) if stored else described_cte(c.job_description, f"sem{i}"))
        ctes.append(f"""s{i} AS (
  SELECT *, {final()} AS Final_Score, (Exp_Years >= {int(c.min_exp)} AND Passes_Mandatory) AS Eligible,
         {reason(c)} AS Reason
  FROM (SELECT *, {exp_score(c)} AS Exp_Score, {skill_score(c)} AS Skill_Score, {passes(c)} AS Passes_Mandatory
        FROM (SELECT res.* EXCLUDE (Resume_Text), sem{i}.Semantic_Score, {cand()} AS cand
              FROM res JOIN sem{i} USING (doc_id))))""")
        ctes.append(f"""t{i} AS (SELECT {round_even(f'quantile_cont(Final_Score, {sc.LOW_QUANTILE})', 6)} AS low,
       {round_even(f'quantile_cont(Final_Score, {sc.HIGH_QUANTILE})', 6)} AS high FROM s{i})""")
        ctes.append(f"""l{i} AS (SELECT s{i}.*, CASE WHEN Final_Score >= high THEN 'High'
       WHEN Final_Score >= low THEN 'Medium' ELSE 'Low' END AS Label,
       row_number() OVER (ORDER BY {ORDER}) AS rn FROM s{i}, t{i} WHERE Eligible)""")
        selects.append(f"SELECT {int(c.jd_id)} AS jd_id, CAST(rn AS INTEGER) AS rank, {RECORDS} "
                       f"FROM l{i} WHERE rn <= {int(c.top_n)}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(selects)


def _criteria_table_sql() -> str:
    """Every document against every criteria row, by joins."""
    items = f"list_transform(string_split(skill_text, ','), lambda x: {strip('x')})"
    required = f"list_transform({items}, lambda s: CASE WHEN starts_with(s, '!') THEN {strip('substr(s, 2)')} ELSE s END)"
    mandatory = f"list_transform(list_filter({items}, lambda s: starts_with(s, '!')), lambda s: {strip('substr(s, 2)')})"
    rcand = f"list_transform(string_split(Skills_List, ','), lambda x: lower({strip('x')}))"
    matched = f"list_filter(requested, lambda s: list_contains({rcand}, lower(s)))"
    parts = [f"CASE WHEN Semantic_Score >= {dbl(sc.STRONG_SEMANTIC)} THEN {lit(sc.STRONG_PHRASE)} "
             f"WHEN Semantic_Score >= {dbl(sc.MODERATE_SEMANTIC)} THEN {lit(sc.MODERATE_PHRASE)} END",
             f"CASE WHEN Exp_Years > 0 THEN CAST(Exp_Years AS VARCHAR) || {lit(sc.EXPERIENCE_PHRASE.replace('{}', ''))} END",
             f"CASE WHEN len({matched}) > 0 THEN {lit(sc.SKILLS_PHRASE.replace('{}', ''))} || "
             f"array_to_string(({matched})[1:{sc.REASON_MAX_SKILLS}], ', ') END"]
    arr = f"list_filter([{', '.join(parts)}], lambda p: p IS NOT NULL)"
    why = (f"CASE WHEN len({arr}) > 0 THEN {lit(sc.REASON_PREFIX)} || array_to_string({arr}, {lit(sc.REASON_JOIN)}) "
           f"ELSE {lit(sc.BASELINE_REASON)} END")
    return f"""WITH {RAW},
{RES},
{vector_ctes()},
crit AS (SELECT *, list_distinct(list_transform(requested, lambda s: lower(s))) AS required,
                list_distinct(list_transform(must, lambda s: lower(s))) AS mandatory
         FROM (SELECT *, coalesce({required}, []) AS requested, coalesce({mandatory}, []) AS must FROM ({CRITERIA_SQL}))),
qv AS (SELECT jd_id, b, c * coalesce(w, length(bin(n))) AS y FROM ({_buckets('job_description', 'jd_id', 'crit')}) LEFT JOIN wgt USING (b), n_docs),
qn AS (SELECT jd_id, CAST(sum(y * y) AS DOUBLE) AS q FROM qv GROUP BY jd_id),
dots AS (SELECT doc_id, jd_id, CAST(sum(x * y) AS DOUBLE) AS d FROM dv JOIN qv USING (b) GROUP BY ALL),
p1 AS (SELECT res.* EXCLUDE (Resume_Text), crit.*, {cand()} AS cand, coalesce(d / sqrt(s * q), 0e0) AS Semantic_Score
       FROM res CROSS JOIN crit LEFT JOIN nrm USING (doc_id) LEFT JOIN qn USING (jd_id) LEFT JOIN dots USING (doc_id, jd_id)),
p2 AS (SELECT *, len(list_filter(mandatory, lambda m: NOT list_contains(cand, m))) = 0 AS ok,
              CASE WHEN Exp_Years < min_exp THEN 0e0 ELSE least(1e0, (Exp_Years - min_exp + 1) / 10e0) END AS Exp_Score FROM p1),
p3 AS (SELECT *, CASE WHEN NOT ok THEN 0e0 WHEN len(required) = 0 THEN 1e0
                      ELSE len(list_filter(required, lambda r: list_contains(cand, r))) / CAST(len(required) AS DOUBLE) END AS Skill_Score
       FROM p2),
p4 AS (SELECT *, {final()} AS Final_Score, Exp_Years >= min_exp AND ok AS Eligible FROM p3),
cut AS (SELECT jd_id, {round_even(f'quantile_cont(Final_Score, {sc.LOW_QUANTILE})', sc.THRESHOLD_DECIMALS)} AS low,
               {round_even(f'quantile_cont(Final_Score, {sc.HIGH_QUANTILE})', sc.THRESHOLD_DECIMALS)} AS high FROM p4 GROUP BY jd_id),
won AS (SELECT *, CAST(row_number() OVER (PARTITION BY jd_id ORDER BY {ORDER}) AS INTEGER) AS rank FROM p4 WHERE Eligible),
named AS (SELECT *, {why} AS Reason, CASE WHEN Final_Score >= high THEN 'High' WHEN Final_Score >= low THEN 'Medium' ELSE 'Low' END AS Label
          FROM won JOIN cut USING (jd_id) WHERE rank <= top_n)
SELECT jd_id, rank, {RECORDS} FROM named"""


def build() -> dict[str, str]:
    S = scored_ctes()
    n = cat.CRITERIA.top_n
    q: dict[str, str] = {}
    q["extract_email"] = f"SELECT doc_id, {email('text')} AS Email FROM documents"
    q["extract_phone"] = (f"SELECT doc_id, {phone_from_candidate('_pc')} AS Phone FROM "
                          f"(SELECT doc_id, {phone_candidate('text')} AS _pc FROM documents)")
    q["clean_text"] = f"SELECT doc_id, {clean('text')} AS Resume_Text FROM documents"
    q["min_length_filter"] = (f"SELECT doc_id, length({strip('text')}) AS stripped_chars FROM documents "
                              f"WHERE {long_enough('text')}")
    q["extract_experience"] = f"WITH {RAW} SELECT doc_id, {experience('raw_text')} AS Exp_Years FROM raw"
    q["extract_skills"] = f"WITH {RAW} SELECT doc_id, {skills('raw_text')} AS Skills_List FROM raw"
    q["skills_theta_join"] = (f"WITH {RAW}, vocab AS (SELECT unnest({str_list(tx.sorted_vocab())}) AS skill) "
                              f"SELECT raw.doc_id, vocab.skill FROM raw JOIN vocab "
                              f"ON contains(lower(raw.raw_text), vocab.skill) WHERE {long_enough('raw.raw_text')}")
    q["skills_vocabulary_table"] = f"""WITH w AS (SELECT regexp_extract_all(lower(text), {lit(VOCABULARY_WORD)}) AS w FROM benchmark),
vocab AS (SELECT DISTINCT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS skill FROM w),
found AS (SELECT doc_id, list(skill ORDER BY skill) AS skills
          FROM documents JOIN vocab ON contains(lower(text), skill) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(skills), 0) AS n_skills, coalesce(array_to_string(skills, ', '), '') AS Skills_List
FROM documents d LEFT JOIN found USING (doc_id)"""
    q["extract_fields"] = (f"WITH {RAW},\n{RES}\nSELECT doc_id, Resume_ID, Source_File, Resume_Text, Email, "
                           f"Phone, Exp_Years, Skills_List FROM res")
    q["resume_table"] = f"""WITH raw0 AS (SELECT doc_id, source AS archive, {RAW_TEXT_SQL} AS raw_text,
        concat_ws('/', source, CAST(doc_id AS VARCHAR) || '.txt') AS name,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx FROM documents)
SELECT archive, printf('R%04d', idx) AS Resume_ID, regexp_extract(name, '[^/]*$', 0) AS Source_File,
       {clean('raw_text')} AS Resume_Text, {email('raw_text')} AS Email, {phone_from_candidate('_pc')} AS Phone,
       {experience('raw_text')} AS Exp_Years, {skills('raw_text')} AS Skills_List
FROM (SELECT *, {phone_candidate('raw_text')} AS _pc FROM raw0) WHERE {long_enough('raw_text')}"""
    ext = " OR ".join(f"ends_with(lower(url), {lit(e.lower())})" for e in cat.HTML_EXTENSIONS)
    q["entry_filter"] = (f"SELECT page_id, url FROM pages WHERE ({ext}) "
                         f"AND NOT starts_with(url, {lit(tx.SKIPPED_PREFIX)})")
    q["entry_ordinal"] = ("SELECT source, doc_id, CAST(idx AS BIGINT) AS idx, printf('R%04d', idx) AS Resume_ID "
                          "FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) "
                          "AS idx FROM documents)")
    q["html_text"] = html_text_sql()
    items = (f"list_filter(list_transform(string_split("
             f"CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '' END || regexp_extract(raw_text, {lit(r'Skills: ([^\n]*)')}, 1), ','), "
             f"lambda x: {strip('x')}), lambda x: x <> '')")
    req = (f"list_transform({items}, lambda s: CASE WHEN starts_with(s, '!') THEN {strip('substr(s, 2)')} "
           f"ELSE s END)")
    mand = f"list_transform(list_filter({items}, lambda s: starts_with(s, '!')), lambda s: {strip('substr(s, 2)')})"
    q["parse_skills"] = (f"WITH {RAW} SELECT doc_id, array_to_string({req}, '|') AS required, "
                         f"array_to_string({mand}, '|') AS mandatory, CAST(len({req}) AS INTEGER) AS n_required FROM raw")
    c = cat.CRITERIA
    q["experience_score"] = f"WITH {RAW},\n{RES}\nSELECT doc_id, Exp_Years, {exp_score(c)} AS Exp_Score FROM res"
    q["skills_score"] = (f"WITH {RAW},\n{RES}\nSELECT doc_id, {skill_score(c, cand())} AS Skill_Score, "
                         f"{passes(c, cand())} AS Passes_Mandatory FROM res")
    q["mandatory_filter"] = f"WITH {RAW},\n{RES}\nSELECT doc_id, Resume_ID FROM res WHERE {passes(c, cand())}"
    q["eligibility"] = f"{S}\nSELECT doc_id, Exp_Years, Passes_Mandatory, Eligible FROM scored"
    q["final_score"] = f"{S}\nSELECT doc_id, Semantic_Score, Exp_Score, Skill_Score, Final_Score FROM scored"
    q["semantic_scores"] = f"WITH {sem_cte('sem', cat.QUERY_VECTOR_ID, 'vec_id')} SELECT vec_id, Semantic_Score FROM sem"
    q["l2_normalize"] = ("SELECT vec_id, CASE WHEN nrm = 0 THEN v ELSE list_transform(v, lambda x: x / nrm) END AS unit "
                         "FROM (SELECT vec_id, v, sqrt(list_reduce(list_prepend(0e0, list_transform(v, lambda x: x * x)), "
                         "lambda a, b: a + b)) AS nrm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))")
    q["score_thresholds"] = f"{S}\nSELECT low, high FROM thr"
    q["score_labels"] = f"{S}\nSELECT doc_id, Final_Score, Label FROM lab"
    q["reasons"] = f"{S}\nSELECT doc_id, Reason FROM scored"
    q["eligible_split"] = f"{S}\nSELECT doc_id, Resume_ID, Final_Score FROM lab WHERE Eligible"
    q["not_eligible_split"] = f"{S}\nSELECT doc_id, Resume_ID, Final_Score FROM lab WHERE NOT Eligible"
    q["ranked_records"] = f"{S}\nSELECT row_number() OVER (ORDER BY Eligible DESC, {ORDER}) AS pos, {RECORDS} FROM lab"
    q["top_candidates"] = f"{S},\n{top_cte(n)}\nSELECT {RECORDS} FROM top"
    q["others_pool"] = f"{S},\n{top_cte(n)}\n{others_sql(n)}"
    q["candidate_cards"] = f"""{S},
{top_cte(n)}
SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank, Resume_ID, Source_File, Email, Phone, Exp_Years,
       array_to_string(({cand()})[1:6], ', ') AS skills,
       printf('%.3f', {round_even('Final_Score', 3)}) AS score, Reason
FROM top"""
    q["summary"] = (f"{S}\nSELECT count(*) AS total, count_if(Eligible) AS eligible, "
                    f"least(CAST({n} AS BIGINT), count_if(Eligible)) AS returned_top FROM lab")
    rk_metrics = metrics_sql("lab", "Label", "Label", sc.LABELS).split("\nSELECT ", 1)
    q["rank_candidates"] = f"""{S},
{top_cte(n)}{rk_metrics[0]},
m AS (SELECT {rk_metrics[1]})
SELECT (SELECT count(*) FROM lab) AS total, (SELECT count_if(Eligible) FROM lab) AS eligible,
       least(CAST({n} AS BIGINT), (SELECT count_if(Eligible) FROM lab)) AS returned_top,
       thr.low, thr.high, m.accuracy, m.macro_precision, m.macro_recall, m.macro_f1,
       coalesce((SELECT string_agg(Resume_ID, ',' ORDER BY {ORDER}) FROM top), '') AS top_ids
FROM thr, m"""
    r = cat.RERANK_CRITERIA
    q["rerank"] = f"{scored_ctes(r)},\n{top_cte(r.top_n)}\nSELECT {RECORDS} FROM top"
    q["rank_stored_vectors"] = f"{scored_ctes(c, cat.QUERY_VECTOR_ID)}\nSELECT {RECORDS} FROM lab"
    q["topn_criteria_table"] = _criteria_table_sql()
    q["display_text"] = (f"{S}\nSELECT doc_id, printf('%.1f%%', Semantic_Score * 100e0) AS percent, Label || ' Match' AS title FROM lab")
    q["row_counters"] = (f"WITH {RAW} SELECT count(*) AS members, count_if({long_enough('raw_text')}) AS extracted, "
                         f"count_if({long_enough('raw_text')}) AS ranked_rows FROM raw")
    q["topn_per_query"] = _many_sql(stored=False)
    q["topn_stored_vectors"] = _many_sql(stored=True)
    q["embed_documents"] = f"""WITH {RAW},
{RES},
{vector_ctes()}
SELECT doc_id, list(coalesce(x / sqrt(s), 0e0) ORDER BY r.b) AS embedding
FROM (SELECT doc_id, unnest(range({em.DEFAULT_DIM})) AS b FROM res) r LEFT JOIN dv USING (doc_id, b) LEFT JOIN nrm USING (doc_id)
GROUP BY doc_id"""
    q["score_histogram"] = S + histogram_sql("scored", "Final_Score", mt.SCORE_BINS)
    q["experience_histogram"] = S + histogram_sql("scored", "Exp_Years", mt.EXPERIENCE_BINS)
    q["score_density"] = S + density_sql("scored", "Final_Score")
    q["confusion_matrix"] = S + confusion_sql("lab", "Label", "Label", sc.LABELS)
    q["per_class_metrics"] = S + per_class_sql("lab", "Label", "Label", sc.LABELS)
    q["ranking_metrics"] = S + metrics_sql("lab", "Label", "Label", sc.LABELS)
    q["quality_confusion_matrix"] = _quality() + confusion_sql("q", "actual", "predicted", cat.QUALITY_LABELS)
    q["quality_class_metrics"] = _quality() + per_class_sql("q", "actual", "predicted", cat.QUALITY_LABELS)
    q["quality_metrics"] = _quality() + metrics_sql("q", "actual", "predicted", cat.QUALITY_LABELS)
    q["embedding_cache_misses"] = f"""WITH {RAW},
{RES},
hashed AS (SELECT doc_id, sha256(Resume_Text) AS text_hash FROM res),
cache AS (SELECT sha256(Resume_Text) AS text_hash FROM res WHERE doc_id IN (SELECT vec_id FROM embeddings))
SELECT doc_id, text_hash FROM hashed WHERE text_hash NOT IN (SELECT text_hash FROM cache)"""
    return q


ORACLE_SQL: dict[str, str] = build()
