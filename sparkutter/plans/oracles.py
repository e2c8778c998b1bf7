"""The queries of ``queries`` in SQL for DuckDB."""

from __future__ import annotations

from ..functions.lexicon import Lexicon
from ..operators.features import column_name
from ..operators.tokens import DESCRIPTIONS, DISFLUENT, LABELS
from .queries import DEMO, SHIPPED, fixed_weights

PUNCT = ".,!?;:\"''()[]{}"


def one_of(x: str, items) -> str:
    items = sorted(items)
    return "(" + (f"coalesce({x} IN ({', '.join(repr(i) for i in items)}), false)" if items else "false") + ")"


def norm(x: str) -> str:
    return f"rtrim(ltrim(lower({x}), '{PUNCT}-'), '{PUNCT}')"


def collapse(x: str) -> str:
    """Without back-references: a character goes if both before it are the same."""
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, k: NOT (k > 2 AND c = string_split({x}, '')[k - 1] AND c = string_split({x}, '')[k - 2])), '')"


def category(w: str, lex: Lexicon) -> str:
    parts = [(lex.pauses, "filled_pause"), (lex.ambiguous, "filled_pause_ambiguous"), (lex.editing, "editing_term"), (lex.markers, "discourse_marker")]
    return "(CASE " + " ".join(f"WHEN {one_of(w, s)} THEN '{name}'" for s, name in parts) + " END)"


def filler(w: str, lex: Lexicon) -> str:
    return one_of(w, lex.pauses | lex.ambiguous | lex.editing | lex.markers)


def known(w: str, lex: Lexicon) -> str:
    """Listed, or an affix around a doubled stem (the six patterns, split at the hyphen)."""
    a, b, two = f"split_part({w}, '-', 1)", f"split_part({w}, '-', 2)", f"len({w}) - len(replace({w}, '-', '')) = 1"
    stem = lambda x: f"regexp_full_match({x}, '[a-z]+')"
    forms = [
        f"{a} = 'ber' || {b} AND {stem(b)}", f"{a} = 'ter' || {b} AND {stem(b)}", f"({b} = 'me' || {a} OR regexp_full_match({b}, 'me[nmngy].*') AND substr({b}, 4) = {a}) AND {stem(a)}",
        f"{b} = {a} || 'an' AND {stem(a)}", f"{a} LIKE 'se%' AND {b} = substr({a}, 3) || 'nya' AND regexp_full_match({a}, 'se[a-z]+')", f"{a} LIKE 'ke%' AND {b} = substr({a}, 3) || 'an' AND regexp_full_match({a}, 'ke[a-z]+')",
    ]
    return f"({one_of(w, lex.doubled | lex.function_doubled)} OR ({two} AND ({' OR '.join(f'({x})' for x in forms)})))"


def can_double(w: str, lex: Lexicon) -> str:
    return f"({one_of(w, lex.function_doubled)} OR NOT ({one_of(w, lex.function)} OR {filler(w, lex)}) AND len({w}) >= 3)"


def hyphen_doubled(w: str, lex: Lexicon) -> str:
    a, b = f"split_part({w}, '-', 1)", f"split_part({w}, '-', 2)"
    ends = f"(suffix({b}, {a}) OR suffix({a}, {b}) OR prefix({b}, {a}) OR prefix({a}, {b}))"
    return f"(len({w}) - len(replace({w}, '-', '')) = 1 AND {a} <> '' AND {b} <> '' AND ({known(w, lex)} OR CASE WHEN {a} = {b} THEN {can_double(a, lex)} ELSE {ends} END))"


def with_(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


DOCS = r"""raw AS (
  SELECT doc_id, lang, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS i
  FROM (SELECT doc_id, lang, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS ws FROM documents)
)"""
# Each distinct word is worked out once.
VOCAB = f"""vocab AS (
  SELECT raw, norm, {collapse("norm")} AS w, greatest(1, len(regexp_extract_all(replace(norm, '-', ''), '[aiueo]+')))::INT AS syl
  FROM (SELECT raw, {norm("raw")} AS norm FROM (SELECT DISTINCT raw FROM raw))
)"""
TOK = f"{DOCS}, {VOCAB}, tok AS (SELECT doc_id, lang, i, raw, norm, w, syl FROM raw JOIN vocab USING (raw))"
NEUTRAL = (
    TOK
    + """, dur AS (SELECT *, greatest(50, 60 + 85 * syl) AS d FROM tok), timed AS (
  SELECT *, e - d AS s FROM (SELECT *, (250 + i * 130 + sum(d) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM dur)
)"""
)
TIMED = (
    TOK
    + """, dur AS (SELECT *, ((greatest(50, 60 + 85 * syl) * (2 + i % 7)) // 4)::BIGINT AS d, CASE WHEN i = 0 THEN 0 ELSE (len(raw) * 37 + i * 13) % 300 - 20 END AS g FROM tok), timed AS (
  SELECT *, e - d AS s FROM (SELECT *, (250 + sum(d + g) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e FROM dur)
)"""
)


def gap_rule(gap: str, seconds: bool = False) -> str:
    if seconds:
        return f"CASE WHEN {gap} <= 0.08::DOUBLE THEN 1.5::DOUBLE WHEN {gap} >= 0.18::DOUBLE THEN -1.5::DOUBLE ELSE 1.5::DOUBLE + (-3.0::DOUBLE) * (({gap} - 0.08::DOUBLE) / (0.18::DOUBLE - 0.08::DOUBLE)) END"
    return f"CASE WHEN {gap} <= 80 THEN 1500 WHEN {gap} >= 180 THEN -1500 ELSE 1500 - 30 * ({gap} - 80) END"


def rules(w: str, lex: Lexicon) -> dict[str, str]:
    pair = f"({w} || '-' || {w})"
    function = f"({one_of(w, lex.function)} AND NOT {one_of(pair, lex.function_doubled)})"
    return {
        "known_reduplication": known(pair, lex),
        "already_doubled": f"({w} LIKE '%-%' AND {hyphen_doubled(w, lex)})",
        "function_word": function,
        "open_class": f"(NOT {function} AND {can_double(w, lex)})",
        "filler_repeated": filler(w, lex),
    }


def events(lex: Lexicon, source: str = "timed", seconds: bool = False) -> str:
    """ev: one row for each adjacent pair, with the score in thousandths; with ``seconds`` all in doubles, as the features have it."""
    holds = rules("w", lex)
    words = " + ".join(f"CASE WHEN {holds[k]} THEN {v} ELSE 0 END" for k, v in zip(holds, ("3.0::DOUBLE", "-3.0::DOUBLE", "-3.0::DOUBLE", "0.5::DOUBLE", "-2.5::DOUBLE") if seconds else (3000, -3000, -3000, 500, -2500), strict=True))
    length = "CASE WHEN d1 > 0 AND d2 > 0 AND d1 / d2 < 0.6 THEN -800 WHEN d1 > 0 AND d2 > 0 AND d1 / d2 >= 0.8 AND d1 / d2 <= 1.25 THEN 400 ELSE 0 END"
    run = "CASE WHEN run_length >= 3 THEN -2000 ELSE 0 END"
    now = "e, d"
    if seconds:
        length = length.replace("-800", "-0.8::DOUBLE").replace("400", "0.4::DOUBLE").replace("0.6 ", "0.6::DOUBLE ").replace("0.8 AND", "0.8::DOUBLE AND").replace("1.25 ", "1.25::DOUBLE ")
        run, now = run.replace("-2000", "-2.0::DOUBLE"), "e / 1000, e / 1000 - s / 1000"
    margin = "0.75" if seconds else "750"
    verdict = lambda x: f"CASE WHEN {x} > {margin} THEN 'reduplication' WHEN {x} < -{margin} THEN 'disfluency' ELSE 'ambiguous' END"
    return f"""isl AS (
  SELECT *, sum(CASE WHEN w <> '' AND w = pw THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(w) OVER o AS pw, lag({now.split(", ")[0]}) OVER o AS pe, lag({now.split(", ")[1]}) OVER o AS d1, {now.split(", ")[1]} AS d2 FROM {source} WINDOW o AS (PARTITION BY doc_id ORDER BY i))
), base AS (
  SELECT w, {words} AS word_score, {", ".join(f"{holds[k]} AS {k}" for k in holds)} FROM (SELECT DISTINCT w FROM {source})
), ev AS (
  SELECT *, {verdict("score")} AS verdict, {verdict("bare")} AS bare_verdict FROM (
    SELECT x.*, word_score + {gap_rule("gap", seconds)} + {length} + {run} AS score, word_score + {run} AS bare, {", ".join(holds)}
    FROM (SELECT *, {"greatest(0.0::DOUBLE, s / 1000 - pe)" if seconds else "greatest(0, s - pe)"} AS gap, count(*) OVER (PARTITION BY doc_id, run) AS run_length FROM isl) x JOIN base USING (w)
    WHERE x.w <> '' AND x.w = x.pw
  )
)"""


def phrases(lex: Lexicon, source: str) -> str:
    """ph: ``source`` with the longest phrase at each token, and in_marker."""
    n, cat = "NULL", "NULL"
    for size in range(2, lex.longest_phrase + 1):
        words = " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, size))])
        for kind in ("discourse_marker", "editing_term"):
            items = [p for p, c in lex.phrases.items() if c == kind and p.count(" ") == size - 1]
            n, cat = f"CASE WHEN {one_of(words, items)} THEN {size} ELSE {n} END", f"CASE WHEN {one_of(words, items)} THEN '{kind}' ELSE {cat} END"
    ahead = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, 8))
    back = ", ".join(f"lag(w, {k}) OVER o AS b{k}" for k in range(1, 5))
    return f"""near AS (SELECT *, {ahead}, {back} FROM {source} WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hit AS (SELECT *, {n} AS phrase_n, {cat} AS phrase_cat FROM near),
chain AS (SELECT doc_id, i, phrase_n AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit WHERE phrase_cat = 'discourse_marker'),
taken(doc_id, k, i, n, free, ok) AS (
  SELECT doc_id, k, i, n, i + n, true FROM chain WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.k, c.i, c.n, CASE WHEN c.i >= t.free THEN c.i + c.n ELSE t.free END, c.i >= t.free FROM taken t JOIN chain c ON c.doc_id = t.doc_id AND c.k = t.k + 1
),
inside AS (SELECT DISTINCT doc_id, i + unnest(range(0, n)) AS i FROM taken WHERE ok),
ph AS (SELECT hit.*, inside.i IS NOT NULL AS in_marker FROM hit LEFT JOIN inside ON hit.doc_id = inside.doc_id AND hit.i = inside.i)"""


def singles(lex: Lexicon) -> str:
    """sg: ph with the label after phrases and single fillers."""
    following = f"(w1 IS NOT NULL AND {filler('w1', lex)})"
    marker = "(NOT in_marker AND cat IS NOT DISTINCT FROM 'discourse_marker')"
    passes = f"({marker} AND ({one_of('w', lex.openers)} AND i > 0 OR {one_of('w', lex.answers)} AND NOT {following}))"
    sets = f"(in_marker OR coalesce(cat IN ('filled_pause', 'filled_pause_ambiguous'), false) OR {marker} AND NOT ({one_of('w', lex.demonstratives)} AND {one_of('w1', lex.tails)}))"
    return f"""sg AS (
  SELECT *, CASE WHEN in_marker THEN 'DM' WHEN cat IS NULL OR NOT coalesce(f, false) THEN 'O' WHEN cat IN ('filled_pause', 'filled_pause_ambiguous') THEN 'FP' ELSE 'DM' END AS lab1
  FROM (SELECT *, last_value(CASE WHEN {passes} THEN NULL ELSE {sets} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS f
    FROM (SELECT *, {category("w", lex)} AS cat FROM ph))
)"""


def repairs(lex: Lexicon, source: str, blocked: str) -> str:
    """rp: ``source`` with term_n and reparandum_n; ``blocked`` is a condition on a row."""
    strong = one_of("w", lex.strong)
    term = f"(coalesce({category('w', lex)} IN ('editing_term', 'filled_pause_ambiguous'), false) AND ({one_of('w', lex.editing)} OR {strong}))"
    phrase = "(phrase_cat IS NOT DISTINCT FROM 'editing_term')"
    longest = max([1, *(p.count(" ") + 1 for p, c in lex.phrases.items() if c == "editing_term")])
    best = "NULL"
    for n in range(1, longest + 1):
        found = "NULL"
        for m in range(1, 5):
            pairs = [(f"b{m - k}", f"w{n + k}") for k in range(m)]
            match = " OR ".join(f"{a} = {b} OR len({a}) >= 4 AND len({b}) >= 4 AND left({a}, 4) = left({b}, 4)" for a, b in pairs)
            found = f"CASE WHEN b{m} IS NOT NULL AND w{n + m - 1} IS NOT NULL AND ({match}) THEN {m} ELSE {found} END"
        fallback = f"CASE WHEN b1 IS NOT NULL AND w{n} IS NOT NULL AND strong_ AND NOT coalesce(before_, false) THEN 1 END"
        best = f"CASE WHEN n_ = {n} THEN coalesce({found}, {fallback}) ELSE {best} END"
    return f"""rq AS (
  SELECT *, CASE WHEN reparandum_q IS NOT NULL THEN n_ END AS term_q FROM (
    SELECT *, {best} AS reparandum_q FROM (
      SELECT *, CASE WHEN {phrase} THEN phrase_n WHEN {term} THEN 1 ELSE 0 END AS n_, {phrase} OR {strong} AS strong_, lag({blocked}) OVER (PARTITION BY doc_id ORDER BY i) AS before_ FROM {source}
    )
  )
), terms AS (SELECT doc_id, i, term_q AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM rq WHERE term_q IS NOT NULL),
accepted(doc_id, k, i, n, free, ok) AS (
  SELECT doc_id, k, i, n, i + n, true FROM terms WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.k, c.i, c.n, CASE WHEN c.i >= t.free THEN c.i + c.n ELSE t.free END, c.i >= t.free FROM accepted t JOIN terms c ON c.doc_id = t.doc_id AND c.k = t.k + 1
),
rp AS (SELECT rq.*, CASE WHEN a.ok THEN term_q END AS term_n, CASE WHEN a.ok THEN reparandum_q END AS reparandum_n FROM rq LEFT JOIN accepted a ON rq.doc_id = a.doc_id AND rq.i = a.i)"""


def ruled(lex: Lexicon) -> str:
    """ru: timed tokens with label (naive) and pred (rules)."""
    o = "OVER (PARTITION BY doc_id ORDER BY i)"
    stem = "rtrim(w, '-')"
    begun = f"(len({stem}) >= 2 AND {stem} <> w1 AND prefix(w1, {stem}) AND NOT {one_of(stem, lex.function)} AND NOT {filler(stem, lex)} AND ga <= 350)"
    cut_off = f"(w <> '' AND (suffix(rtrim(raw), '-') AND len({stem}) >= 1 OR coalesce({begun}, false)))"
    naive = "CASE WHEN w = w1 THEN 'REP' WHEN in_marker THEN 'DM' WHEN cat IN ('filled_pause', 'filled_pause_ambiguous') THEN 'FP' WHEN cat IN ('discourse_marker', 'editing_term') THEN 'DM' ELSE 'O' END"
    reparandum = " OR ".join(f"coalesce(lead(reparandum_n, {k}) {o} >= {k}, false)" for k in range(1, 5))
    term = " OR ".join(f"coalesce(lag(term_n, {k}) {o} > {k}, false)" for k in range(1, lex.longest_phrase))
    return f"""{TIMED}, {phrases(lex, "timed")}, {singles(lex)}, {events(lex)},
fin AS (
  SELECT *, CASE WHEN verdict IS NOT DISTINCT FROM 'disfluency' AND lab2 <> 'PW' THEN 'REP' ELSE lab2 END AS lab3 FROM (
    SELECT g.*, e2.verdict, CASE WHEN lab1 = 'O' AND {cut_off} THEN 'PW' ELSE lab1 END AS lab2
    FROM (SELECT *, greatest(0, lead(s) {o} - e) AS ga FROM sg) g LEFT JOIN (SELECT doc_id AS d_, i - 1 AS i_, verdict FROM ev) e2 ON g.doc_id = e2.d_ AND g.i = e2.i_
  )
), {repairs(lex, "fin", "lab3 IN ('FP', 'DM')")},
ru AS (SELECT doc_id, lang, i, raw, w, s, e, d, {naive} AS label, CASE WHEN {reparandum} OR term_n IS NOT NULL OR {term} THEN 'RPR' ELSE lab3 END AS pred FROM rp)"""


RULED = ruled(DEMO)
DIS = "(" + ", ".join(repr(x) for x in DISFLUENT) + ")"
CUT = "('FP', 'REP', 'RPR', 'PW')"


def spans(label: str, name: str) -> str:
    return f"""{name} AS (
  SELECT doc_id, {label} AS label, min(i) AS i, max(i) + 1 AS j, min(s) AS s, max(e) AS e, string_agg(raw, ' ' ORDER BY i) AS text
  FROM (SELECT *, sum(CASE WHEN {label} = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
    FROM (SELECT *, lag({label}) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM ru))
  WHERE {label} IN {DIS} GROUP BY doc_id, run, {label}
)"""


def f_measure(tp: str, fp: str, fn: str) -> tuple[str, str, str]:
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    return p, r, f"coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0)"


EDL = f"""{RULED}, pos AS (
  SELECT *, pred IN {CUT} AS c, row_number() OVER o AS p, lag(e) OVER o AS pe, lead(s) OVER o AS ns, lag(pred IN {CUT}) OVER o AS pc, min(s) OVER (PARTITION BY doc_id) AS b, max(e) OVER (PARTITION BY doc_id) AS f
  FROM ru WINDOW o AS (PARTITION BY doc_id ORDER BY s, i)
), runs AS (
  SELECT doc_id, run, arg_min(s, p)::DOUBLE AS s, arg_max(e, p)::DOUBLE AS e, arg_min(pe, p)::DOUBLE AS before, min(b)::DOUBLE AS b, max(f)::DOUBLE AS f,
    (SELECT NULL) AS dummy, arg_max(coalesce(ns, -1), p)::DOUBLE AS after_, min(p) AS p0, string_agg(pred, '+' ORDER BY p) AS labels, string_agg(raw, ' ' ORDER BY p) AS text
  FROM (SELECT *, sum(CASE WHEN c = pc THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM pos) WHERE c GROUP BY doc_id, run
), wide AS (
  SELECT *, CASE WHEN after_ < 0 THEN NULL ELSE after_ END AS after, CASE WHEN p0 = 1 THEN NULL ELSE before END AS bef FROM runs
), edge AS (
  SELECT *, coalesce(bef, b) AS lft, coalesce(after, f) AS rgt FROM wide
), cuts AS (
  SELECT doc_id, run, labels, text, greatest(CASE WHEN bef IS NOT NULL THEN greatest(s0, bef + 30) ELSE s0 END, lft) AS s, least(CASE WHEN after IS NOT NULL THEN least(e0, after - 30) ELSE e0 END, rgt) AS e
  FROM (SELECT *, s - greatest(0.0, s - lft) * 0.5 AS s0, e + greatest(0.0, rgt - e) * 0.5 AS e0 FROM edge)
), raw_cuts AS (SELECT * FROM cuts WHERE e - s >= 50),
merged AS (
  SELECT doc_id, n, min(s) AS s, max(e) AS e, string_agg(labels, '+' ORDER BY s, run) AS labels, string_agg(text, ' ' ORDER BY s, run) AS text
  FROM (SELECT *, sum(CASE WHEN s - m <= 120 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, run) - 1 AS n
    FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM raw_cuts))
  GROUP BY doc_id, n
), bounds AS (SELECT doc_id, min(s)::DOUBLE AS b, max(e)::DOUBLE AS f FROM ru GROUP BY doc_id),
kept AS (
  SELECT doc_id, s, e FROM (
    SELECT doc_id, max(e) OVER w AS s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY at_, s NULLS FIRST), f) AS e
    FROM (SELECT doc_id, NULL::DOUBLE AS s, b AS e, b AS at_, f FROM bounds UNION ALL SELECT m.doc_id, m.s, m.e, m.s, f FROM merged m JOIN bounds USING (doc_id))
    WINDOW w AS (PARTITION BY doc_id ORDER BY at_, s NULLS FIRST ROWS UNBOUNDED PRECEDING)
  ) WHERE e - s > 0.001
)"""

EVENTS = """span AS (
  SELECT user_id, event_id, event_type, s, s + floor(abs(coalesce(value, 0)))::BIGINT AS e, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) - 1 AS i
  FROM (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS s FROM events)
), gap AS (SELECT user_id, greatest(0, s - pe) AS gap FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY i) AS pe FROM span) WHERE pe IS NOT NULL)"""


def timecode(ms: str) -> str:
    ms = f"greatest({ms}, 0)"
    return f"printf('%02d:%02d:%02d.%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


def md5_bucket(x: str, m: int) -> str:
    half = lambda a: f"(('0x' || substr(md5({x}), {a}, 16))::UBIGINT::HUGEINT)"
    return f"((({half(1)} % {m}) * {2**64 % m} + {half(17)} % {m}) % {m})::INT"


LOOPS = (
    DOCS
    + """, t AS (SELECT doc_id, i, lower(raw) AS t FROM raw), period AS (SELECT unnest([1, 2, 3, 4]) AS k),
same AS (SELECT t.doc_id, t.i, t.t, k, lead(t.t, k) OVER (PARTITION BY t.doc_id, k ORDER BY t.i) AS ahead, lead(t.t, 1) OVER o AS t1, lead(t.t, 2) OVER o AS t2, lead(t.t, 3) OVER o AS t3 FROM t, period WINDOW o AS (PARTITION BY t.doc_id, k ORDER BY t.i)),
stops AS (SELECT *, min(CASE WHEN ahead IS NOT DISTINCT FROM t AND ahead IS NOT NULL THEN NULL ELSE i END) OVER (PARTITION BY doc_id, k ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS stop FROM same),
cand AS (
  SELECT doc_id, i AS a, i + k * r AS z, k, r, array_to_string(list_slice([t, t1, t2, t3], 1, k), ' ') AS content
  FROM (SELECT *, 1 + (stop - i) // k AS r FROM stops) WHERE r >= 4
), fused AS (
  SELECT *, sum(CASE WHEN a < m THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a, z - a DESC, k) AS loop, row_number() OVER (PARTITION BY doc_id ORDER BY a, z - a DESC, k) AS ord
  FROM (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z - a DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cand)
), loops AS (
  SELECT doc_id AS file, min(a) AS begin, max(z) AS stop, arg_max(k, (z - a) * 10000000 - ord) AS period, arg_max(r, (z - a) * 10000000 - ord) AS rounds, arg_max(content, (z - a) * 10000000 - ord) AS content
  FROM fused GROUP BY doc_id, loop
)"""
)

FEATURE = (
    f"{TIMED}, {phrases(DEMO, 'timed')}, {events(DEMO)}, "
    + repairs(DEMO, "ph", f"(in_marker OR coalesce({category('w', DEMO)} IN ('filled_pause', 'filled_pause_ambiguous', 'discourse_marker'), false))")
    + f""", ft AS (
  SELECT *, {" OR ".join(f"coalesce(lead(reparandum_n, {k}) OVER o >= {k}, false)" for k in range(1, 5))} OR coalesce(term_n > 1, false) OR {" OR ".join(f"coalesce(lag(term_n, {k}) OVER o > {k + 1}, false)" for k in range(1, DEMO.longest_phrase))} AS rep,
    coalesce(term_n = 1, false) OR {" OR ".join(f"coalesce(lag(term_n, {k}) OVER o = {k + 1}, false)" for k in range(1, DEMO.longest_phrase))} AS term,
    count(*) OVER (PARTITION BY doc_id) AS n, coalesce({category("w", DEMO)}, 'none') AS cat, avg(e::DOUBLE / 1000 - s::DOUBLE / 1000) OVER (PARTITION BY doc_id) AS mean
  FROM rp WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), fa AS (
  SELECT *, lag(term) OVER o AS after_, lag(cat) OVER o AS pcat, lead(cat) OVER o AS ncat, {", ".join(f"lead(term, {k}) OVER o AS a{k}" for k in range(1, 5))},
    coalesce(lag(w) OVER o, '<bos>') AS p1, coalesce(lag(w, 2) OVER o, '<bos>') AS p2, coalesce(lead(w) OVER o, '<eos>') AS n1, coalesce(lead(w, 2) OVER o, '<eos>') AS n2, e::DOUBLE / 1000 - s::DOUBLE / 1000 AS secs,
    coalesce(greatest(0.0, s / 1000 - lag(e / 1000) OVER o), 0) AS gb, coalesce(greatest(0.0, lead(s / 1000) OVER o - e / 1000), 0) AS ga
  FROM ft WINDOW o AS (PARTITION BY doc_id ORDER BY i)
)"""
)


def flag(x: str) -> str:
    return f"CASE WHEN coalesce({x}, false) THEN 'True' ELSE 'False' END"


def bucket(x: str, edges) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {e} THEN 'b{k}'" for k, e in enumerate(edges)) + f" ELSE 'b{len(edges)}' END"


def summed(base: str, table: str, parts: dict[str, str]) -> str:
    """Of each document and feature, the sum of the first 28 bits of its values' MD5."""
    sums = ", ".join(f"sum(('0x' || substr(md5({v}), 1, 7))::BIGINT)::BIGINT AS \"{column_name(k)}\"" for k, v in parts.items())
    return f"WITH RECURSIVE {base} SELECT doc_id, count(*) AS tokens, {sums} FROM {table} GROUP BY doc_id"


def q(base: str, select: str) -> str:
    return f"WITH RECURSIVE {base} {select}"


def labels_of(x: str) -> str:
    return "CASE WHEN pred IN " + DIS + f" THEN {x} END"


_prf = f_measure("tp", "fp", "fn")
_conf = "cf AS (SELECT label AS gold, pred, count(*) AS n FROM ru GROUP BY ALL)"
_per = "pl AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM (SELECT gold AS label, n AS tp, 0 AS fp, 0 AS fn FROM cf WHERE gold = pred UNION ALL SELECT pred, 0, n, 0 FROM cf WHERE gold <> pred UNION ALL SELECT gold, 0, 0, n FROM cf WHERE gold <> pred) GROUP BY label)"
_redup = f"""rd AS (SELECT *, label = 'O' AND ({hyphen_doubled("w", DEMO)} OR w <> '' AND (coalesce(pl = 'O' AND pw = w, false) OR coalesce(nl = 'O' AND nw = w, false))) AS redup
  FROM (SELECT *, lag(label) OVER o AS pl, lag(w) OVER o AS pw, lead(label) OVER o AS nl, lead(w) OVER o AS nw FROM ru WINDOW o AS (PARTITION BY doc_id ORDER BY i)))"""
_spans2 = f"{spans('label', 'gs')}, {spans('pred', 'ps')}, un AS (SELECT doc_id, label, i, j, max(g) AS g, max(p) AS p FROM (SELECT doc_id, label, i, j, 1 AS g, NULL AS p FROM gs UNION ALL SELECT doc_id, label, i, j, NULL, 1 FROM ps) GROUP BY ALL)"
_counters = "count(*) AS tokens, count(*) FILTER (label = pred) AS correct, count(*) FILTER (pred <> 'O' AND label <> 'O') AS binary_tp, count(*) FILTER (pred <> 'O' AND label = 'O') AS binary_fp, count(*) FILTER (pred = 'O' AND label <> 'O') AS binary_fn, count(*) FILTER (label = 'O') AS fluent, count(*) FILTER (label = 'O' AND pred <> 'O') AS fluent_cut, count(*) FILTER (redup) AS redup, count(*) FILTER (redup AND pred <> 'O') AS redup_cut"
_stem = "rtrim(w, '-')"
_partial = f"(w <> '' AND (suffix(rtrim(raw), '-') AND len({_stem}) >= 1 OR coalesce(len({_stem}) >= 2 AND {_stem} <> nw AND prefix(nw, {_stem}) AND NOT {one_of(_stem, DEMO.function)} AND NOT {filler(_stem, DEMO)} AND ga <= 350, false)))"
_nw = "nx AS (SELECT *, lead(w) OVER o AS nw, greatest(0, lead(s) OVER o - e) AS ga FROM timed WINDOW o AS (PARTITION BY doc_id ORDER BY i))"
_cat = category("w", DEMO)
_fill = f"""count(*) AS tokens, count(*) FILTER (cat = 'filled_pause') AS filled_pause, count(*) FILTER (cat = 'filled_pause_ambiguous') AS filled_pause_ambiguous, count(*) FILTER (cat = 'discourse_marker') AS discourse_marker,
  count(*) FILTER (cat = 'editing_term' AND {one_of("w", DEMO.strong)}) AS editing_strong, count(*) FILTER (cat = 'editing_term' AND NOT {one_of("w", DEMO.strong)}) AS editing_weak"""

_gaps = (0.02, 0.05, 0.08, 0.12, 0.18, 0.25, 0.35, 0.5)
_ratio = bucket("(CASE WHEN mean > 0 THEN secs / mean ELSE 1 END)", ("0.5::DOUBLE", "0.8::DOUBLE", "1.2::DOUBLE", "1.8::DOUBLE"))
_shape = r"""CASE WHEN regexp_matches(raw, '^\p{Lu}') OR regexp_matches(raw, '\p{Nd}') OR raw LIKE '%-%' THEN concat_ws('|', CASE WHEN regexp_matches(raw, '^\p{Lu}') THEN 'Cap' END, CASE WHEN regexp_matches(raw, '\p{Nd}') THEN 'Num' END, CASE WHEN suffix(raw, '-') THEN 'TrailHyphen' WHEN raw LIKE '%-%' THEN 'Hyphen' END) ELSE 'plain' END"""
_redup_features = {
    "eqprev": flag("w = pw"), "eqnext": flag("w = nw"), "hyphredup": flag(hyphen_doubled("w", DEMO)), "reduplicable": flag(can_double("w", DEMO)), "partial": flag(_partial), "repeat_first": "coalesce(v1, 'none')", "repeat_second": "coalesce(v2, 'none')", "verdict": "v1",
}
_conv = r"SELECT conv_id, turn, conv_id || '-' || turn AS file, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS n FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations)"
_prov = """SELECT 'f' || doc_id AS berkas, CASE WHEN doc_id % 2 = 0 THEN 'd/' || doc_id ELSE 's/' || doc_id END AS address, CASE WHEN doc_id % 4 <> 0 THEN n_chars / 8 END AS d, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE n_chars * 2 END AS o,
  CASE WHEN doc_id % 4 <> 0 AND doc_id % 6 <> 0 THEN (n_chars / 8) / nullif(n_chars * 2, 0) END AS share,
  concat_ws('+', CASE WHEN doc_id % 5 = 0 OR trim(coalesce(source, '')) = '' THEN 'penutur' END, CASE WHEN doc_id % 7 = 0 OR trim(coalesce(lang, '')) = '' THEN 'lisensi' END, CASE WHEN doc_id % 3 = 0 THEN 'tanggal_ambil' END) AS open
  FROM documents WHERE doc_id % 11 <> 0"""
_meaning = "CASE " + " ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in DESCRIPTIONS.items()) + " END"

SQL = {
    "tokenize": q(DOCS, "SELECT doc_id, count(*) AS n_tokens, sum(len(raw))::BIGINT AS n_letters FROM raw GROUP BY doc_id"),
    "canonical_vocab": q(TOK, "SELECT w, count(*) AS n FROM tok GROUP BY w"),
    "syllables": q(TOK, "SELECT syl AS syllables, count(*) AS n FROM tok GROUP BY syl"),
    "collapse_repeats": q(TOK, "SELECT norm, w, count(*) AS n FROM tok WHERE norm <> w GROUP BY norm, w"),
    "shapes": q(DOCS, r"""SELECT CASE WHEN x = '' THEN 'plain' ELSE x END AS shape, count(*) AS n FROM (
      SELECT concat_ws('|', CASE WHEN regexp_matches(raw, '^\p{Lu}') THEN 'Cap' END, CASE WHEN regexp_matches(raw, '\p{Nd}') THEN 'Num' END, CASE WHEN suffix(raw, '-') THEN 'TrailHyphen' WHEN raw LIKE '%-%' THEN 'Hyphen' END) AS x FROM raw) GROUP BY 1"""),
    "lexicon_category": q(TOK, f"SELECT coalesce({category('w', SHIPPED)}, 'none') AS shipped, coalesce({_cat}, 'none') AS demo, count(*) AS n FROM tok GROUP BY 1, 2"),
    "function_words": q(TOK, f"SELECT w, count(*) AS n FROM tok WHERE {one_of('w', SHIPPED.function)} OR {one_of('w', DEMO.function)} GROUP BY w"),
    "can_double": q(TOK, f"SELECT {can_double('w', DEMO)} AS can_double, count(*) AS words, sum(n)::BIGINT AS n FROM (SELECT w, count(*) AS n FROM tok GROUP BY w) GROUP BY 1"),
    "known_redup_hyphen": q(TOK, f"SELECT w, {known('w', SHIPPED)} AS known, count(*) AS n FROM tok WHERE w LIKE '%-%' GROUP BY 1, 2"),
    "hyphen_redup": q(TOK, f"""SELECT {hyphen_doubled('w', SHIPPED)} AS hyphen_doubled, {known('w', SHIPPED)} AS known, sum(n)::BIGINT AS n FROM (
      SELECT {collapse('j')} AS w, n FROM (SELECT w || '-' || nw AS j, count(*) AS n FROM (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nw FROM tok) WHERE w <> '' AND nw <> '' GROUP BY 1)) GROUP BY 1, 2"""),
    "partial_words": q(f"{TIMED}, {_nw}", f"SELECT w, count(*) AS n FROM nx WHERE {_partial} GROUP BY w"),
    "neutral_timing": q(NEUTRAL, "SELECT doc_id, max(e) AS finish, sum(s)::BIGINT AS starts, sum(d)::BIGINT AS spoken FROM timed GROUP BY doc_id"),
    "gaps": q(EVENTS, "SELECT user_id, count(*) AS gaps, sum(gap)::BIGINT AS silence, max(gap) AS longest FROM gap GROUP BY user_id"),
    "gap_zones": q(EVENTS, "SELECT CASE WHEN gap <= 5000 THEN 'reduplication' WHEN gap >= 40000 THEN 'disfluency' ELSE 'grey' END AS zone, count(*) AS n, sum(gap)::BIGINT AS silence FROM gap GROUP BY 1"),
    "gap_median": q(EVENTS, """SELECT *, round(zero / gaps, 6) AS zero_share, zero / gaps < 0.2 AS prosody_trusted FROM (
      SELECT coalesce(user_id::VARCHAR, 'all') AS user_id, count(*) AS gaps, count(*) FILTER (gap <= 0.000001) AS zero, count(*) FILTER (gap <= 5000) AS reduplication, count(*) FILTER (gap > 5000 AND gap < 40000) AS grey, count(*) FILTER (gap >= 40000) AS disfluency, quantile_cont(gap, 0.5)::DOUBLE AS median
      FROM gap GROUP BY GROUPING SETS ((gap.user_id), ()))"""),
    "repeat_runs": q(f"{TIMED}, {events(SHIPPED)}", "SELECT w AS base, run_length, count(*) AS n FROM ev GROUP BY 1, 2"),
    "repeat_verdicts": q(f"{TIMED}, {events(SHIPPED)}", "SELECT doc_id, verdict, count(*) AS n, sum(score)::BIGINT AS score FROM ev GROUP BY 1, 2"),
    "repeat_reasons": q(f"{TIMED}, {events(DEMO)}", """SELECT reason, verdict, bare_verdict AS verdict_without_prosody, count(*) AS n FROM (
      SELECT unnest([CASE WHEN known_reduplication THEN 'known_reduplication' END, CASE WHEN already_doubled THEN 'already_doubled' END, CASE WHEN function_word THEN 'function_word' END, CASE WHEN open_class THEN 'open_class' END, CASE WHEN filler_repeated THEN 'filler_repeated' END,
        CASE WHEN gap <= 80 THEN 'gap_short' WHEN gap >= 180 THEN 'gap_long' ELSE 'gap_between' END, CASE WHEN d1 / d2 < 0.6 THEN 'length_clipped' WHEN d1 / d2 BETWEEN 0.8 AND 1.25 THEN 'length_equal' END, CASE WHEN run_length >= 3 THEN 'run_three_or_more' END]) AS reason, verdict, bare_verdict FROM ev)
      WHERE reason IS NOT NULL GROUP BY 1, 2, 3"""),
    "multiword_fillers": q(f"{TOK}, {phrases(DEMO, 'tok')}", "SELECT doc_id, count(*) FILTER (in_marker) AS in_marker, count(phrase_n) AS phrases FROM ph GROUP BY doc_id"),
    "single_fillers": q(f"{TOK}, {phrases(DEMO, 'tok')}, {singles(DEMO)}", "SELECT w, lab1 AS label_now, count(*) AS n FROM sg WHERE lab1 <> 'O' GROUP BY 1, 2"),
    "repair_windows": q(f"{TOK}, {phrases(DEMO, 'tok')}, " + repairs(DEMO, "ph", f"(in_marker OR coalesce({_cat} IN ('filled_pause', 'filled_pause_ambiguous', 'discourse_marker'), false))"), "SELECT doc_id, i - reparandum_n AS start, i + term_n - 1 AS last FROM rp WHERE term_n IS NOT NULL"),
    "naive_labels": q(RULED, "SELECT doc_id, label AS pred, count(*) AS n, sum(i)::BIGINT AS places FROM ru GROUP BY 1, 2"),
    "rule_labels": q(RULED, "SELECT doc_id, pred, count(*) AS n, sum(i)::BIGINT AS places FROM ru GROUP BY 1, 2"),
    "label_spans": q(f"{RULED}, {spans('pred', 'ps')}", "SELECT doc_id, label, count(*) AS spans, sum(j - i)::BIGINT AS words, sum(e - s)::BIGINT AS ms, sum(len(text))::BIGINT AS letters FROM ps GROUP BY 1, 2"),
    "label_counts": q(RULED, f"SELECT l.label, count(ru.pred) AS n FROM (SELECT unnest({list(LABELS)}) AS label) l LEFT JOIN ru ON l.label = ru.pred GROUP BY l.label"),
    "describe": q(RULED, f"SELECT count(*) AS utterances, sum(n)::BIGINT AS tokens, sum(d)::BIGINT AS disfluent, round(sum(d) / sum(n), 4) AS disfluent_share, sum(t)::BIGINT AS speech FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (pred IN {DIS}) AS d, max(e) - min(s) AS t FROM ru GROUP BY doc_id)"),
    "clean_text": q(RULED, "SELECT doc_id, md5(coalesce(string_agg(CASE WHEN pred = 'O' THEN raw END, ' ' ORDER BY i), '')) AS clean_md5 FROM ru GROUP BY doc_id"),
    "confusion": q(f"{RULED}, {_conf}", "SELECT gold, pred, n FROM cf"),
    "confusion_table": q(RULED, "SELECT label AS gold, " + ", ".join(f"count(*) FILTER (pred = '{x}') AS \"{x}\"" for x in LABELS) + " FROM ru GROUP BY label"),
    "label_prf": q(f"{RULED}, {_conf}, {_per}", f"SELECT label, tp, fp, fn, round({_prf[0]}, 6) AS precision, round({_prf[1]}, 6) AS recall, round({_prf[2]}, 6) AS f1 FROM pl"),
    "binary_prf": f"SELECT tp, fp, fn, round({_prf[0]}, 6) AS precision, round({_prf[1]}, 6) AS recall, round({_prf[2]}, 6) AS f1 FROM (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fp, count(*) FILTER (quality = 0 AND toxic <> 1) AS fn FROM labels)",
    "span_prf": q(f"{RULED}, {_spans2}", "SELECT count(*) FILTER (g = 1 AND p = 1) AS span_tp, count(*) FILTER (g IS NULL) AS span_fp, count(*) FILTER (p IS NULL) AS span_fn FROM un"),
    "redup_preservation": q(f"{RULED}, {_redup}", f"SELECT {_counters} FROM rd"),
    "kfold": f"SELECT fold, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, {md5_bucket('doc_id::VARCHAR', 5)} AS fold FROM documents) GROUP BY fold",
    "split": f"SELECT {md5_bucket('doc_id::VARCHAR', 100)} < 30 AS is_test, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1",
    "training_folds": f"SELECT held, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, {md5_bucket('doc_id::VARCHAR', 5)} AS fold, unnest([0, 1, 2, 3, 4]) AS held FROM documents) WHERE held <> fold GROUP BY held",
    "edl_cuts": q(EDL, 'SELECT doc_id AS source, s AS start, e AS "end", labels, md5(text) AS text_md5 FROM raw_cuts'),
    "edl_merge": q(EDL, 'SELECT doc_id AS source, n::BIGINT AS n, s AS start, e AS "end", labels, md5(text) AS text_md5 FROM merged'),
    "edl_keeps": q(EDL, 'SELECT doc_id AS source, s AS start, e AS "end" FROM kept'),
    "edl_stats": q(EDL, """SELECT doc_id AS source, f - b AS duration, greatest(0.0, f - b - r) AS kept, r AS removed, round(100 * coalesce(r / nullif(f - b, 0), 0), 2) AS reduction_pct, c AS cuts, k AS keeps
      FROM (SELECT bounds.*, coalesce((SELECT sum(e - s) FROM merged m WHERE m.doc_id = bounds.doc_id), 0.0) AS r, (SELECT count(*) FROM merged m WHERE m.doc_id = bounds.doc_id) AS c, (SELECT count(*) FROM kept m WHERE m.doc_id = bounds.doc_id) AS k FROM bounds)"""),
    "edl_commands": q(EDL, """, pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS k, printf('start=%.3f:end=%.3f', s / 1000, e / 1000) AS c FROM kept)
      SELECT source, md5(CASE WHEN n IS NULL THEN '# nothing is left; check the configuration of cuts' ELSE 'ffmpeg -i "' || source || '" -filter_complex "' || p || ';' || v || 'concat=n=' || n || ':v=1:a=1[v][a]" -map "[v]" -map "[a]" "edl_terpotong.mp4"' END) AS command_md5
      FROM (SELECT 'doc' || doc_id || '.mp4' AS source, n, p, v FROM bounds LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg('[0:v]trim=' || c || ',setpts=PTS-STARTPTS[v' || k || '];[0:a]atrim=' || c || ',asetpts=PTS-STARTPTS[a' || k || ']', ';' ORDER BY k) AS p, string_agg('[v' || k || '][a' || k || ']', '' ORDER BY k) AS v FROM pieces GROUP BY doc_id) USING (doc_id))"""),
    "timecode": q(TIMED, f"SELECT doc_id, {timecode('max(e)')} AS finish, {timecode('(min(s) - 300)')} AS begin FROM timed GROUP BY doc_id"),
    "proof_spans": q(EDL, """, win AS (SELECT *, greatest(b, coalesce(l, b), s - 2000) AS x, least(f, coalesce(r, f), e + 2000) AS y FROM (SELECT m.doc_id, m.n, m.s, m.e, b, f, lag(m.e) OVER o AS l, lead(m.s) OVER o AS r FROM merged m JOIN bounds USING (doc_id) WINDOW o AS (PARTITION BY m.doc_id ORDER BY m.n)))
      SELECT doc_id AS source, n::BIGINT AS n, 0 AS part, 'before' AS kind, x AS start, y AS "end" FROM win WHERE y > x
      UNION ALL SELECT doc_id, n::BIGINT, 1, 'after', x, s FROM win WHERE y > x AND s - x > 0.001 UNION ALL SELECT doc_id, n::BIGINT, 2, 'after', e, y FROM win WHERE y > x AND y - e > 0.001"""),
    "extend_to_media": q(EDL, 'SELECT doc_id AS source, CASE WHEN lag(s) OVER o IS NULL THEN 0.0 ELSE s END AS start, CASE WHEN lead(s) OVER o IS NULL AND e < 100000 THEN 100000.0 ELSE e END AS "end" FROM kept WINDOW o AS (PARTITION BY doc_id ORDER BY s)'),
    "transcripts": q(RULED, f"SELECT doc_id AS source, md5(string_agg(raw, ' ' ORDER BY i)) AS before_md5, md5(coalesce(string_agg(CASE WHEN pred NOT IN {CUT} THEN raw END, ' ' ORDER BY i), '')) AS after_md5 FROM ru GROUP BY doc_id"),
    "sessionize": q(EVENTS, 'SELECT user_id, session::BIGINT AS session, count(*) AS n, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(CASE WHEN s - pe > 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS pe FROM span)) GROUP BY 1, 2'),
    "segments": q(EVENTS, """SELECT user_id, segment::BIGINT AS segment, min(s) AS start, arg_max(e, i) AS "end", string_agg(event_type, '' ORDER BY i) AS text, count(*)::INT AS n
      FROM (SELECT *, sum(CASE WHEN s - pe >= 30000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS segment FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY i) AS pe FROM span)) GROUP BY 1, 2"""),
    "asr_utterances": rf"""WITH RECURSIVE c AS (SELECT conv_id || '-' || turn AS file, unnest(ws) AS raw0, generate_subscripts(ws, 1) - 1 AS n FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations)),
      t AS (SELECT file, n, CASE WHEN n % 7 = 3 THEN '-' || raw0 ELSE raw0 END AS raw, n * 0.5 + (n // 11) * 2.0 AS s FROM c),
      v AS (SELECT * FROM (SELECT *, {norm("raw")} AS nm FROM t) WHERE nm <> ''),
      u AS (SELECT *, sum(CASE WHEN s - pe > 0.8 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY n) AS utt FROM (SELECT *, lag(s + 0.25) OVER (PARTITION BY file ORDER BY n) AS pe FROM v)),
      g AS (SELECT *, sum(CASE WHEN prefix(raw, '-') AND len(raw) > 1 AND p IS NOT NULL AND NOT suffix(p, '-') THEN 0 ELSE 1 END) OVER (PARTITION BY file, utt ORDER BY n) AS part FROM (SELECT *, lag(raw) OVER (PARTITION BY file, utt ORDER BY n) AS p FROM u)),
      k AS (SELECT file, utt, part, string_agg(raw, '' ORDER BY n) AS raw, min(n) AS n, min(s) AS s, max(s + 0.25) AS e FROM g GROUP BY ALL)
      SELECT file, printf('asr-%04d', (utt + 1)::INT) AS uid, count(*) AS n, min(s)::DOUBLE AS start, max(e)::DOUBLE AS "end", md5(string_agg(raw, ' ' ORDER BY n)) AS text_md5 FROM k GROUP BY file, utt""",
    "loop_candidates": q(LOOPS, "SELECT doc_id AS file, k AS period, count(*) AS n, max(r) AS rounds, sum(z)::BIGINT AS stops FROM cand GROUP BY 1, 2"),
    "loop_detect": q(LOOPS, "SELECT file, begin, stop, period, rounds, content FROM loops"),
    "without_loops": q(LOOPS, "SELECT doc_id AS file, count(*) AS n, sum(i)::BIGINT AS places FROM raw WHERE NOT EXISTS (SELECT 1 FROM loops WHERE file = doc_id AND i >= begin AND i < stop) GROUP BY 1"),
    "filler_audit": q(TOK, f"""SELECT *, filled_pause / tokens < 0.0128 AS pauses_missing, round((filled_pause + discourse_marker + editing_strong) / tokens, 6) AS rate, round(filled_pause / tokens, 6) AS pause_rate
      FROM (SELECT lang, {_fill} FROM (SELECT *, {_cat} AS cat FROM tok) GROUP BY GROUPING SETS ((lang), ()))"""),
    "filler_top12": q(TOK, f"SELECT norm AS form, count(*) AS n FROM tok WHERE {filler('w', DEMO)} GROUP BY norm ORDER BY n DESC, min((doc_id, i)) LIMIT 12"),
    "repeat_audit": q(f"{TIMED}, {events(DEMO)}", """SELECT *, round(coalesce(by_prosody / nullif(events, 0), 0), 6) AS prosody_share FROM (SELECT lang, count(*) AS events, count(*) FILTER (verdict = 'reduplication') AS reduplication, count(*) FILTER (verdict = 'disfluency') AS disfluency, count(*) FILTER (verdict = 'ambiguous') AS ambiguous,
      count(*) FILTER (verdict <> bare_verdict) AS by_prosody FROM ev GROUP BY GROUPING SETS ((lang), ()))"""),
    "audit_rollup": q(TIMED, "SELECT lang, count(*) AS utterances, sum(n)::BIGINT AS tokens, sum(t)::BIGINT AS speech FROM (SELECT lang, doc_id, count(*) AS n, max(e) - min(s) AS t FROM timed GROUP BY ALL) GROUP BY GROUPING SETS ((lang), ())"),
    "features_lexical": summed(FEATURE, "fa", {
        "w": "w", "shape": _shape, "len": "least(len(w), 12)::VARCHAR", "suf3": "right(w, 3)", "pre3": "left(w, 3)", "w-1": "p1", "w-2": "p2", "w+1": "n1", "w+2": "n2", "w-1|w": "p1 || '|' || w", "w|w+1": "w || '|' || n1",
        "cat": "cat", "cat-1": "coalesce(pcat, 'none')", "cat+1": "coalesce(ncat, 'none')", "isfp": flag("cat IN ('filled_pause', 'filled_pause_ambiguous')"), "isdm": flag("cat = 'discourse_marker'"), "isedit": flag("cat = 'editing_term'"),
        "isfunc": flag(one_of("w", DEMO.function)), "pos": "CASE WHEN i = 0 THEN 'bos' WHEN i = n - 1 THEN 'eos' ELSE 'mid' END", "relpos": "least(4, 5 * i // n)::VARCHAR", "in_reparandum": flag("rep"), "is_editterm": flag("term"), "after_editterm": flag("after_"),
        "editterm_ahead": "CASE WHEN a1 THEN '1' WHEN a2 THEN '2' WHEN a3 THEN '3' WHEN a4 THEN '4' ELSE '0' END",
    }),
    "features_prosody": summed(FEATURE, "fa", {
        "gapb": bucket("gb", _gaps), "gapa": bucket("ga", _gaps), "dur": bucket("secs", ("0.1::DOUBLE", "0.15::DOUBLE", "0.2::DOUBLE", "0.3::DOUBLE", "0.4::DOUBLE", "0.6::DOUBLE")), "durratio": _ratio, "gapb_long": flag("gb >= 0.18::DOUBLE"), "gapb_tight": flag("gb <= 0.08::DOUBLE"),
    }),
    "features_crossed": summed(FEATURE, "fa", {"w|gapb": "w || '|' || " + bucket("gb", _gaps), "durratio": _ratio}),
    "features_redup": summed(f"{TIMED}, {events(DEMO, seconds=True)}, {_nw}, fr AS (SELECT nx.*, a.verdict AS v1, b.verdict AS v2, lag(nx.w) OVER (PARTITION BY nx.doc_id ORDER BY nx.i) AS pw FROM nx LEFT JOIN (SELECT doc_id AS d_, i - 1 AS i_, verdict FROM ev) a ON nx.doc_id = a.d_ AND nx.i = a.i_ LEFT JOIN (SELECT doc_id AS d2_, i AS i2_, verdict FROM ev) b ON nx.doc_id = b.d2_ AND nx.i = b.i2_)", "fr", _redup_features),
    "jsonl_round_trip": q(RULED, """SELECT doc_id::VARCHAR AS uid, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'seed' END AS source, CASE WHEN doc_id % 3 = 0 THEN 'B' ELSE 'S1' END AS speaker, CASE WHEN doc_id % 5 = 0 THEN lang ELSE '-' END AS meta_lang, label, pred,
      count(*) AS n, sum(i)::BIGINT AS places, sum(len(w))::BIGINT AS letters, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM ru GROUP BY ALL"""),
    "whisper_shapes": f"SELECT file, count(*) AS n, md5(string_agg(w, ' ' ORDER BY n)) AS text_md5, max(n * 0.5 + 0.25)::DOUBLE AS finish FROM ({_conv}) GROUP BY file",
    "usable_chunks": f"SELECT conv_id, count(*) AS n, sum(n)::BIGINT AS places FROM ({_conv}) WHERE n % 5 <> 1 AND n % 7 <> 2 GROUP BY conv_id",
    "trimmed_words": f"""WITH c AS ({_conv}), m AS (SELECT file, turn, n, w, n * 0.5::DOUBLE + 0.0625 AS s0, n * 0.5::DOUBLE + 0.25 + len(w) * 0.0625::DOUBLE AS e0, count(*) OVER (PARTITION BY file) AS size FROM c),
      f AS (SELECT *, CASE WHEN turn % 4 <> 3 THEN 1 END AS known, floor(s0 / 0.125)::BIGINT AS a, least(floor(e0 / 0.125)::BIGINT, 4 * size) AS b FROM m),
      p AS (SELECT *, [k FOR k IN range(a, b + 1) IF NOT ((k * 7 + turn) % 5 < 2 OR k % 23 > 19)] AS loud FROM f),
      t AS (SELECT *, known = 1 AND a <= 4 * size AND b > a AND len(loud) > 0 AND loud[-1] > loud[1] AND (loud[-1] + 1) * 0.125 - loud[1] * 0.125 >= 0.04 AS ok FROM p),
      g AS (SELECT *, CASE WHEN ok THEN round_even((loud[1] * 0.125)::DOUBLE, 3) ELSE s0 END AS s1, CASE WHEN ok THEN round_even(((loud[-1] + 1) * 0.125)::DOUBLE, 3) ELSE e0 END AS e1,
        coalesce(ok AND (abs(loud[1] * 0.125 - s0) > 1e-9 OR abs((loud[-1] + 1) * 0.125 - e0) > 1e-9), false) AS changed FROM t),
      h AS (SELECT *, lead(s1) OVER (PARTITION BY file ORDER BY n) AS nx FROM g)
      SELECT file, n, s1 AS start, CASE WHEN e1 > nx THEN round_even(greatest(s1, nx), 3) ELSE e1 END AS "end", changed FROM h""",
    "provenance_report": f"SELECT berkas, address, round(share, 6) AS quoted_share, open, open = '' AS ready FROM ({_prov})",
    "provenance_totals": f"SELECT sum(d)::DOUBLE AS seconds, count(*) FILTER (d IS NULL) AS unknown, round(sum(CASE WHEN d IS NOT NULL THEN d END) / sum(CASE WHEN d IS NOT NULL THEN o END), 6) AS quoted_share FROM ({_prov})",
    "open_ethics": f"SELECT open, count(*) AS n FROM (SELECT unnest(string_split(open, '+')) AS open FROM ({_prov})) WHERE open <> '' GROUP BY open",
    "only_named": f"SELECT berkas, d AS durasi_detik FROM ({_prov}) WHERE berkas IN ('f1', 'f2', 'f8')",
    "download_status": """SELECT CASE WHEN doc_id % 7 = 0 OR coalesce(source, '') = '' THEN 'no-link' WHEN there IS NOT NULL AND (size IS NULL OR size = there) THEN 'present' WHEN size IS NULL THEN 'to-fetch-unverified' ELSE 'to-fetch' END AS status, count(*) AS n
      FROM (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN n_chars END AS size, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 1 ELSE n_chars END AS there FROM documents) GROUP BY 1""",
    "file_notes": q(TIMED, f""", sp AS (SELECT lang, sum(n)::BIGINT AS tokens, sum(t) / 1000 AS speech FROM (SELECT lang, doc_id, count(*) AS n, arg_max(e, i) - arg_min(s, i) AS t FROM timed GROUP BY ALL) GROUP BY lang),
      fp AS (SELECT lang, count(*) FILTER (cat = 'filled_pause') / count(*) < 0.0128 AS missing FROM (SELECT *, {_cat} AS cat FROM tok) GROUP BY lang), md AS (SELECT lang, sum(n_chars) * 0.1::DOUBLE AS seconds FROM documents WHERE lang <> 'de' GROUP BY lang),
      al AS (SELECT sp.lang, tokens, coalesce(tokens / nullif(speech, 0), 0) AS rate, CASE WHEN seconds > 0 THEN speech / seconds END AS coverage, missing FROM sp JOIN fp USING (lang) LEFT JOIN md USING (lang))
      SELECT lang, tokens, round(rate, 6) AS rate, round(coverage, 6) AS coverage, concat_ws('+', CASE WHEN rate < 1.5 THEN 'slow' END, CASE WHEN coverage < 0.7 THEN 'low coverage' END, CASE WHEN missing THEN 'pauses missing' END) AS notes FROM al"""),
    "filler_forms": q(TOK, f"SELECT norm AS form, count(*) AS n FROM tok WHERE {filler('w', DEMO)} GROUP BY norm"),
    "repeat_confidence": q(f"{TIMED}, {events(DEMO)}", "SELECT verdict, round(least(1.0::DOUBLE, abs(score / 1000) / 3), 2) AS confidence, count(*) AS n FROM ev GROUP BY 1, 2"),
    "erroneous_utterances": q(RULED, ", er AS (SELECT doc_id, max((label <> pred)::INT) AS wrong FROM ru GROUP BY doc_id) SELECT doc_id, wrong FROM er WHERE wrong = (SELECT max(wrong) FROM er) ORDER BY doc_id LIMIT 3"),
    "compare_labels": q(RULED, "SELECT label AS a, pred AS b, count(*) AS n FROM ru GROUP BY 1, 2"),
    "edl_rows": q(EDL, f""", lb AS (SELECT doc_id, n, label, min(k) AS k FROM (SELECT doc_id, n, unnest(string_split(labels, '+')) AS label, generate_subscripts(string_split(labels, '+'), 1) AS k FROM merged) GROUP BY ALL),
      nm AS (SELECT doc_id, n, string_agg(label, '+' ORDER BY k) AS label, string_agg({_meaning}, '; ' ORDER BY k) AS reasons FROM lb GROUP BY doc_id, n)
      SELECT doc_id AS source, n::BIGINT AS n, round(s, 3) AS start, round(e, 3) AS "end", round(e - s, 3) AS duration, {timecode("round_even(s, 0)::BIGINT")} AS start_tc, {timecode("round_even(e, 0)::BIGINT")} AS end_tc, label, md5(text) AS text_md5, reasons FROM merged JOIN nm USING (doc_id, n)"""),
    "edl_bounds": q(EDL, 'SELECT doc_id AS source, min(s) AS begin, max(e) AS finish FROM (SELECT doc_id, s, e FROM merged UNION ALL SELECT doc_id, s, e FROM kept) GROUP BY doc_id'),
    "error_context": q(RULED, """, cx AS (SELECT *, coalesce(greatest(0, s - lag(e) OVER o), 0) AS gb, concat_ws(' ', lag(raw, 3) OVER o, lag(raw, 2) OVER o, lag(raw) OVER o, '[' || raw || ']', lead(raw) OVER o, lead(raw, 2) OVER o, lead(raw, 3) OVER o) AS context FROM ru WINDOW o AS (PARTITION BY doc_id ORDER BY i))
      SELECT doc_id, label AS gold, pred AS predicted, count(*) AS n, sum(gb)::BIGINT AS gap, sum(len(context))::BIGINT AS letters FROM cx WHERE label <> pred GROUP BY 1, 2, 3"""),
    "first_errors": q(RULED, """, cx AS (SELECT *, coalesce(greatest(0, s - lag(e) OVER o), 0) AS gb, concat_ws(' ', lag(raw, 3) OVER o, lag(raw, 2) OVER o, lag(raw) OVER o, '[' || raw || ']', lead(raw) OVER o, lead(raw, 2) OVER o, lead(raw, 3) OVER o) AS context FROM ru WINDOW o AS (PARTITION BY doc_id ORDER BY i))
      SELECT doc_id, i, raw AS token, label AS gold, pred AS predicted, gb AS gap_before, context FROM cx WHERE label <> pred AND label = 'REP' ORDER BY doc_id, i LIMIT 12"""),
    "nested_tokens": q(RULED, "SELECT doc_id, count(*)::INT AS n, md5(string_agg(raw || '/' || pred, ' ' ORDER BY i)) AS tokens_md5 FROM ru GROUP BY doc_id"),
    "annotated_round_trip": q(RULED, "SELECT doc_id, pred AS label, count(*) AS n, sum(len(raw))::BIGINT AS letters FROM ru GROUP BY 1, 2"),
}


def _summary() -> str:
    micro, binary, span = f_measure("tp", "fp", "fn"), f_measure("binary_tp", "binary_fp", "binary_fn"), f_measure("span_tp", "span_fp", "span_fn")
    parts = [f"round({x}, 6) AS {name}_{kind}" for name, three in (("micro", micro), ("binary", binary), ("span", span)) for kind, x in zip(("precision", "recall", "f1"), three, strict=True)]
    p, r, f = f_measure("tp", "fp", "fn")
    macro = ", ".join(f"round(coalesce(avg(CASE WHEN tp + fn > 0 THEN {x} END), 0), 6) AS macro_{kind}" for kind, x in (("precision", p), ("recall", r), ("f1", f)))
    return q(f"""{RULED}, {_redup}, {_spans2}, ct AS (SELECT lang, {_counters} FROM rd GROUP BY lang),
      cf AS (SELECT lang, label AS gold, pred, count(*) AS n FROM ru GROUP BY ALL),
      pl AS (SELECT lang, label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT lang, gold AS label, n AS tp, 0 AS fp, 0 AS fn FROM cf WHERE gold = pred UNION ALL SELECT lang, pred, 0, n, 0 FROM cf WHERE gold <> pred UNION ALL SELECT lang, gold, 0, 0, n FROM cf WHERE gold <> pred) WHERE label <> 'O' GROUP BY lang, label),
      mc AS (SELECT lang, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, {macro} FROM pl GROUP BY lang),
      sp AS (SELECT lang, count(*) FILTER (g = 1 AND p = 1) AS span_tp, count(*) FILTER (g IS NULL) AS span_fp, count(*) FILTER (p IS NULL) AS span_fn FROM un JOIN (SELECT DISTINCT doc_id, lang FROM raw) USING (doc_id) GROUP BY lang)""",
      f"SELECT lang, tokens, round(correct / tokens, 6) AS accuracy, {', '.join(parts)}, macro_precision, macro_recall, macro_f1, redup, redup_cut, round(1 - coalesce(redup_cut / nullif(redup, 0), 0), 6) AS redup_kept, fluent, fluent_cut, round(coalesce(fluent_cut / nullif(fluent, 0), 0), 6) AS fluent_cut_rate FROM ct LEFT JOIN mc USING (lang) LEFT JOIN sp USING (lang)")


SQL["score_summary"] = _summary()


def _decoded() -> tuple[str, str]:
    """SQL for decode and emission_scores: features of reduplication over ``benchmark``, weighted and decoded step by step."""
    model = fixed_weights()
    bench = f"{NEUTRAL.replace('FROM documents', 'FROM (SELECT item_id AS doc_id, NULL AS lang, text FROM benchmark)')}, {events(DEMO, seconds=True)}, {_nw}"
    bench += ", fr AS (SELECT nx.*, a.verdict AS v1, b.verdict AS v2, lag(nx.w) OVER (PARTITION BY nx.doc_id ORDER BY nx.i) AS pw FROM nx LEFT JOIN (SELECT doc_id AS d_, i - 1 AS i_, verdict FROM ev) a ON nx.doc_id = a.d_ AND nx.i = a.i_ LEFT JOIN (SELECT doc_id AS d2_, i AS i2_, verdict FROM ev) b ON nx.doc_id = b.d2_ AND nx.i = b.i2_)"
    names = [n for n in _redup_features if n != "verdict"]
    weigh = lambda j: " + ".join("CASE " + " ".join(f"WHEN f_{n} = '{f.split('=')[1]}' THEN {int(model.emit[i, j])}" for f, i in model.features.items() if f.split("=")[0] == n) + " ELSE 0 END" for n in names)
    listed = ", ".join(weigh(j) for j in range(len(LABELS)))
    bench += f", ff AS (SELECT doc_id, i, {', '.join(f'{_redup_features[n]} AS f_{n}' for n in names)} FROM fr), em AS (SELECT doc_id, i, [{listed}] AS em FROM ff)"
    scores = q(bench, f"SELECT doc_id AS item_id, label, sum(x)::BIGINT AS score FROM (SELECT doc_id, unnest(em) AS x, unnest({list(LABELS)}) AS label FROM em) GROUP BY 1, 2")
    move = "[" + ", ".join("[" + ", ".join(str(int(model.move[k, j])) for k in range(len(LABELS))) + "]" for j in range(len(LABELS))) + "]"
    start = "[" + ", ".join(str(int(x)) for x in model.move[len(LABELS)]) + "]"
    steps = f""", mv AS (SELECT {move} AS mv), walk(doc_id, i, score, path) AS (
      SELECT doc_id, i, list_transform(range(1, 7), lambda j: em[j] + {start}[j]), list_transform(range(1, 7), lambda j: {list(LABELS)}[j]) FROM em WHERE i = 0
      UNION ALL
      SELECT doc_id, i, list_transform(range(1, 7), lambda j: ways[j][came[j]] + em[j]), list_transform(range(1, 7), lambda j: path[came[j]] || ' ' || {list(LABELS)}[j]) FROM (
        SELECT doc_id, i, em, path, ways, list_transform(ways, lambda w: list_position(w, list_max(w))) AS came FROM (
          SELECT em.doc_id, em.i, em.em, walk.path, list_transform(mv, lambda m: list_transform(range(1, 7), lambda k: walk.score[k] + m[k])) AS ways FROM walk JOIN em ON em.doc_id = walk.doc_id AND em.i = walk.i + 1, mv))
    )"""
    labels = q(bench + steps, "SELECT doc_id AS item_id, path[list_position(score, list_max(score))] AS labels FROM (SELECT *, max(i) OVER (PARTITION BY doc_id) AS last FROM walk) WHERE i = last")
    return labels, scores


SQL["decode"], SQL["emission_scores"] = _decoded()
