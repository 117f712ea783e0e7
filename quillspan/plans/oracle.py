"""SQL for DuckDB that computes the catalog's rows by their plain definitions."""

from __future__ import annotations

from quillspan.config import NO_TEXT, TOO_LARGE
from quillspan.functions.text import HEADINGS as _UNICODE_HEADINGS
from quillspan.functions.text import SPACE, STOP_WORDS

HEADINGS = _UNICODE_HEADINGS.replace(SPACE, r"\s")
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sentences(source: str) -> str:
    """CTEs ending in sents(doc_id, sent_idx, sent, char_start) of a relation (doc_id, text)."""
    return rf"""src AS ({source}),
cutup AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s+)([A-Z0-9])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) AS a FROM src),
pieces AS (SELECT doc_id, pos, CASE WHEN pos = 1 THEN 0 ELSE strpos(a[pos], chr(2)) - 1 END AS gap, CASE WHEN pos = 1 THEN a[pos] ELSE substr(a[pos], strpos(a[pos], chr(2)) + 1) END AS raw
  FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS pos FROM cutup)),
placed AS (SELECT doc_id, pos, raw, sum(gap + length(raw)) OVER (PARTITION BY doc_id ORDER BY pos) - length(raw) AS st FROM pieces),
kept AS (SELECT doc_id, pos, {strip("raw")} AS sent, st + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS char_start FROM placed WHERE length({strip("raw")}) > 15),
sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS sent_idx, sent, char_start FROM kept
  UNION ALL SELECT doc_id, 0, CASE WHEN {strip("text")} = '' THEN '{NO_TEXT}' ELSE {strip("text")} END, CASE WHEN {strip("text")} = '' THEN 0 ELSE length(text) - length(regexp_replace(text, '^\s+', '')) END
  FROM src WHERE doc_id NOT IN (SELECT doc_id FROM kept))"""


_DOCS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_WINDOWS = """wide AS (SELECT doc_id, sent_idx AS k, sent AS s0, lead(sent, 1) OVER o AS s1, lead(sent, 2) OVER o AS s2, count(*) OVER (PARTITION BY doc_id) AS n FROM sents WINDOW o AS (PARTITION BY doc_id ORDER BY sent_idx)),
wins AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS win_id, k, CASE WHEN n < 3 THEN s0 ELSE s0 || ' ' || s1 || ' ' || s2 END AS win, s0, s1, s2, n FROM wide WHERE n < 3 OR (k <= n - 3 AND (k % 2 = 0 OR k = n - 3)))"""


def tokens(c: str) -> str:
    return rf"unnest(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}'))"


def cosines(name: str, units: str, keys: str, pairs: str) -> str:
    """CTE name(keys, u, q_id, score) of units(keys, u, txt) against quest, for pairs(keys, q_id) and all their units."""
    k = [x.strip() for x in keys.split(",")]
    on = lambda a, b, more=(): " AND ".join(f"{a}.{x} = {b}.{x}" for x in (*k, *more))
    sel = lambda a: ", ".join(f"{a}.{x}" for x in k)
    return f"""{name}_t AS (SELECT {keys}, u, tok, count(*) AS tf FROM (SELECT {keys}, u, {tokens("txt")} AS tok FROM {units}) WHERE tok NOT IN ({_STOP}) GROUP BY ALL),
{name}_n AS (SELECT {keys}, count(*) AS n FROM {units} GROUP BY ALL),
{name}_d AS (SELECT {keys}, tok, count(*) AS df FROM {name}_t GROUP BY ALL),
{name}_b AS (SELECT {sel("t")}, t.u, sum(t.tf ** 2 * (ln((2 + n.n) / (1 + d.df)) + 1) ** 2) AS base FROM {name}_t t JOIN {name}_d d ON {on("t", "d", ("tok",))} JOIN {name}_n n ON {on("t", "n")} GROUP BY ALL),
{name}_q AS (SELECT {sel("p")}, p.q_id, sum(q.tf ** 2 * (ln((2 + n.n) / (2 + coalesce(d.df, 0))) + 1) ** 2) AS qn FROM {pairs} p JOIN quest_t q ON q.q_id = p.q_id JOIN {name}_n n ON {on("p", "n")} LEFT JOIN {name}_d d ON {on("p", "d")} AND d.tok = q.tok GROUP BY ALL),
{name}_x AS (SELECT {sel("p")}, p.q_id, t.u, sum(t.tf * q.tf * (ln((2 + n.n) / (2 + d.df)) + 1) ** 2) AS dot, sum(t.tf ** 2 * ((ln((2 + n.n) / (2 + d.df)) + 1) ** 2 - (ln((2 + n.n) / (1 + d.df)) + 1) ** 2)) AS adj
  FROM {pairs} p JOIN quest_t q ON q.q_id = p.q_id JOIN {name}_t t ON {on("p", "t")} AND t.tok = q.tok JOIN {name}_d d ON {on("t", "d", ("tok",))} JOIN {name}_n n ON {on("t", "n")} GROUP BY ALL),
{name} AS (SELECT {sel("x")}, x.q_id, x.u, round(x.dot / sqrt((b.base + x.adj) * q.qn), 6) AS score FROM {name}_x x JOIN {name}_b b ON {on("x", "b", ("u",))} JOIN {name}_q q ON {on("x", "q", ("q_id",))})"""


_QUEST = f"""quest AS (SELECT item_id AS q_id, text AS question FROM benchmark),
quest_t AS (SELECT q_id, tok, count(*) AS tf FROM (SELECT q_id, {tokens("question")} AS tok FROM quest) WHERE tok NOT IN ({_STOP}) GROUP BY ALL)"""
_SCORES = f"""{_QUEST},
units AS (SELECT doc_id, win_id AS u, win AS txt FROM wins),
pairs AS (SELECT d.doc_id, q.q_id FROM (SELECT DISTINCT doc_id FROM wins) d CROSS JOIN quest q),
{cosines("sc", "units", "doc_id", "pairs")}"""
#: Every window of every pair that has a score, ranked, with the percentile over all of them.
_RANKED = """every AS (SELECT w.doc_id, p.q_id, w.win_id, w.win, coalesce(s.score, 0.0) AS score FROM (SELECT doc_id, q_id FROM sc GROUP BY ALL) p JOIN wins w ON w.doc_id = p.doc_id LEFT JOIN sc s ON s.doc_id = p.doc_id AND s.q_id = p.q_id AND s.u = w.win_id),
cutoff AS (SELECT doc_id, q_id, quantile_cont(score, 0.4) AS p40, max(score) AS max_score, count(*) FILTER (score > 0) AS n_scored FROM every GROUP BY ALL HAVING max(score) > 0),
best AS (SELECT e.*, c.p40, row_number() OVER (PARTITION BY e.doc_id, e.q_id ORDER BY e.score DESC, e.win_id) AS rk FROM every e JOIN cutoff c ON c.doc_id = e.doc_id AND c.q_id = e.q_id),
fast AS (SELECT doc_id, q_id, win_id, win, row_number() OVER (PARTITION BY doc_id, q_id ORDER BY win_id) AS nth FROM best WHERE rk <= 8 AND score >= round(p40, 9)),
pool AS (SELECT doc_id, q_id, win_id, win, row_number() OVER (PARTITION BY doc_id, q_id ORDER BY win_id) AS nth FROM best WHERE rk <= 20),
walked AS (SELECT *, sum(2 * len(string_split_regex(win, '\\s+'))) OVER (PARTITION BY doc_id, q_id ORDER BY nth) AS cum FROM pool),
budget AS (SELECT * FROM walked WHERE cum <= 480 OR nth = 1)"""


def _base(*more: str, source: str = _DOCS) -> str:
    return "WITH " + ",\n".join([sentences(source), *more]) + "\n"


_DEEP = _base(_WINDOWS, _SCORES, _RANKED)


def _ask(chosen: str, source: str = _DOCS) -> str:
    """CTEs ending in answered(doc_id, q_id, ctx, ans, st, en, conf)."""
    return (
        _base(_WINDOWS, _SCORES, _RANKED, source=source)
        + rf""", ctx AS (SELECT doc_id, q_id, string_agg(win, ' ' ORDER BY nth) AS ctx FROM {chosen} GROUP BY ALL),
bits AS (SELECT doc_id, q_id, ctx, list_filter(list_transform(string_split(regexp_replace(ctx, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {strip("s")}), lambda s: length(s) > 10) AS b FROM ctx),
full_bits AS (SELECT doc_id, q_id, ctx, CASE WHEN len(b) = 0 THEN [ctx] ELSE b END AS b FROM bits),
cunits AS (SELECT doc_id, q_id AS cq, i - 1 AS u, b[i] AS txt FROM (SELECT doc_id, q_id, b, unnest(range(1, len(b) + 1)) AS i FROM full_bits)),
cpairs AS (SELECT doc_id, q_id AS cq, q_id FROM ctx),
{cosines("cs", "cunits", "doc_id, cq", "cpairs")},
top AS (SELECT doc_id, cq AS q_id, max(score) AS conf, arg_min(u, -score * 1000000 + u / 100000) AS u FROM cs GROUP BY ALL),
answered AS (SELECT f.doc_id, f.q_id, ctx, b[coalesce(t.u, 0) + 1] AS ans, coalesce(t.conf, 0.0) AS conf FROM full_bits f LEFT JOIN top t ON t.doc_id = f.doc_id AND t.q_id = f.q_id)"""
    )


def _responses(chosen: str) -> str:
    return (
        _ask(chosen)
        + """ SELECT d.doc_id, q.q_id, coalesce(ans, '') AS answer, md5(coalesce(ctx, '')) AS context_md5, CASE WHEN ans IS NULL THEN -1 ELSE greatest(strpos(ctx, ans) - 1, 0) END AS char_start,
coalesce(strpos(ctx, ans) - 1 + length(ans), -1) AS char_end, round(coalesce(conf, 0.0), 2) AS confidence, ans IS NOT NULL AS found, CASE WHEN ans IS NULL THEN 0.0 ELSE 1.0 END AS retrieval_confidence,
CASE WHEN ans IS NULL THEN NULL ELSE 0 END AS page_number, CAST(NULL AS VARCHAR) AS error
FROM (SELECT doc_id FROM documents) d CROSS JOIN quest q LEFT JOIN answered a ON a.doc_id = d.doc_id AND a.q_id = q.q_id"""
    )


_WORDS = r"""words AS (SELECT doc_id, i - 1 AS ord, (i - 1) // 300 AS page, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM
  (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents)))"""
_OFFSETS = "offs AS (SELECT doc_id, ord, page, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM words)"
_PAGED = f"WITH {_WORDS}, {_OFFSETS},\n"
_PAGED_TEXT = "SELECT doc_id, string_agg(word, ' ' ORDER BY ord) AS text FROM words WHERE page < 25 GROUP BY doc_id"
_REF_TEXT = f"""SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' REFERENCES [1] Smith and others wrote this. Another Entry follows it.' WHEN 2 THEN ' End of it. Literature Cited. Some Entry that is longer.'
  WHEN 3 THEN ' for this see the references to later work.' ELSE '' END AS text FROM ({_PAGED_TEXT})"""
_REFS = rf""", by_sent AS (SELECT doc_id, min(sent_idx) AS bound FROM sents WHERE length(sent) <= 40 AND regexp_full_match(lower(sent), '\s*({HEADINGS})\s*[.:]*\s*') GROUP BY ALL),
tails AS (SELECT doc_id, CAST(floor(0.6 * length(text)) AS INT) AS cut_at, substr(text, CAST(floor(0.6 * length(text)) AS INT) + 1) AS tail FROM src),
at_text AS (SELECT doc_id, cut_at + length(string_split_regex(tail, '(?im)(^|[\s.])({HEADINGS})([\s\[\d]|$)')[1]) + CASE WHEN regexp_matches(regexp_extract(tail, '(?im)(^|[\s.])({HEADINGS})([\s\[\d]|$)'), '^[\s.]') THEN 1 ELSE 0 END AS ch
  FROM tails WHERE regexp_matches(tail, '(?im)(^|[\s.])({HEADINGS})([\s\[\d]|$)')),
by_text AS (SELECT s.doc_id, min(s.sent_idx) AS bound FROM sents s JOIN at_text a ON a.doc_id = s.doc_id WHERE s.char_start >= a.ch GROUP BY ALL),
marked AS (SELECT s.doc_id, s.sent_idx, coalesce(s.sent_idx >= coalesce(b.bound, t.bound), false) AS past_references FROM sents s LEFT JOIN by_sent b ON b.doc_id = s.doc_id LEFT JOIN by_text t ON t.doc_id = s.doc_id)"""
_PAIRS = rf""", nb AS (SELECT doc_id, sent_idx, sent AS gold, lead(sent) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS nxt FROM sents),
items AS (SELECT doc_id, sent_idx, gold, CASE (doc_id + sent_idx) % 6 WHEN 0 THEN gold WHEN 1 THEN '' WHEN 2 THEN concat_ws(' ', nxt, nxt) WHEN 3 THEN '  ' || replace(gold, 'e', 'E') || ' ...' WHEN 4 THEN '?!' ELSE concat_ws(' ', substr(gold, 1, 40), nxt) END AS pred,
  concat_ws(' ', gold, nxt) AS ctx, (doc_id * 7 + sent_idx) % 11 = 0 AS failed FROM nb),
clean AS (SELECT *, lower({strip("gold")}) AS g, lower({strip("pred")}) AS p FROM items),
toks AS (SELECT *, list_filter(string_split_regex(g, '\s+'), lambda x: x <> '') AS gw, list_filter(string_split_regex(p, '\s+'), lambda x: x <> '') AS pw FROM clean),
bare AS (SELECT *, list_filter(list_transform(gw, lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~')), lambda x: x <> '') AS gb, list_filter(list_transform(pw, lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~')), lambda x: x <> '') AS pb FROM toks),
used AS (SELECT *, CASE WHEN len(gb) = 0 THEN gw ELSE gb END AS gt, CASE WHEN len(pb) = 0 THEN pw ELSE pb END AS pt FROM bare),
gc AS (SELECT doc_id, sent_idx, t, count(*) AS c FROM (SELECT doc_id, sent_idx, unnest(gt) AS t FROM used) GROUP BY ALL),
pc AS (SELECT doc_id, sent_idx, t, count(*) AS c FROM (SELECT doc_id, sent_idx, unnest(pt) AS t FROM used) GROUP BY ALL),
same AS (SELECT gc.doc_id, gc.sent_idx, sum(least(gc.c, pc.c)) AS n FROM gc JOIN pc ON gc.doc_id = pc.doc_id AND gc.sent_idx = pc.sent_idx AND gc.t = pc.t GROUP BY ALL),
scored AS (SELECT u.doc_id, u.sent_idx, NOT failed AND g <> '' AND strpos(lower(ctx), g) > 0 AS retrieval_hit, NOT failed AND p = g AS exact_match,
  CASE WHEN failed THEN 0.0 WHEN p = g THEN CASE WHEN p <> '' THEN 1.0 ELSE 0.0 END WHEN p = '' OR g = '' OR coalesce(s.n, 0) = 0 THEN 0.0 ELSE 2.0 * (s.n / len(pt)) * (s.n / len(gt)) / (s.n / len(pt) + s.n / len(gt)) END AS f1
  FROM used u LEFT JOIN same s ON s.doc_id = u.doc_id AND s.sent_idx = u.sent_idx)"""

#: From answered to the page of each answer, by offs(doc_id, page, char_start) of the words.
_GROUNDING = """, starts AS (SELECT doc_id, page, min(char_start) AS st FROM offs WHERE page < 25 GROUP BY ALL),
sp AS (SELECT s.doc_id, s.sent_idx, coalesce(p.page, 0) AS page FROM sents s ASOF LEFT JOIN starts p ON s.doc_id = p.doc_id AND s.char_start >= p.st),
spots AS (SELECT doc_id, q_id, ans, strpos(ctx, ans) - 1 AS c, length(ans) AS n_ans FROM answered),
laid AS (SELECT *, coalesce(sum(length(win) + 1) OVER (PARTITION BY doc_id, q_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws FROM fast),
hits_w AS (SELECT l.doc_id, l.q_id, l.win_id, a.ans, a.c, a.n_ans, a.c - l.ws AS pos, row_number() OVER (PARTITION BY l.doc_id, l.q_id ORDER BY CASE WHEN l.ws <= a.c AND a.c < l.ws + length(l.win) THEN l.nth ELSE 1000 - l.nth END) AS rk
  FROM laid l JOIN spots a ON a.doc_id = l.doc_id AND a.q_id = l.q_id)
SELECT h.doc_id, h.q_id, h.c AS char_start, h.c + h.n_ans AS char_end, sp.page AS page_number FROM hits_w h JOIN wins w ON w.doc_id = h.doc_id AND w.win_id = h.win_id
JOIN sp ON sp.doc_id = h.doc_id AND sp.sent_idx = w.k + CASE WHEN w.n < 3 THEN 0 WHEN h.pos >= length(s0) + length(s1) + 2 THEN 2 WHEN h.pos >= length(s0) + 1 THEN 1 ELSE 0 END WHERE h.rk = 1"""
_GROUNDED = f"WITH {_WORDS}, {_OFFSETS},\n" + _ask("fast", _PAGED_TEXT).removeprefix("WITH ") + _GROUNDING
#: The derived word boxes; their rows are far apart, so a fold over a page finds just the rows they were laid out in.
_BOXES = f"""WITH {_WORDS},
cells AS (SELECT doc_id, page, ord AS seq, word, doc_id % 2 = 1 AS two, ord % 300 AS i FROM words),
geo AS (SELECT doc_id, page, seq, word, CASE WHEN two THEN i % 150 // 5 ELSE i // 10 END AS row_id,
  CASE WHEN two THEN (i % 150 % 5 + i // 150 * 5) * 30.0 + i // 150 * 60.0 ELSE i % 10 * 30.0 END AS x0 FROM cells),
placed_w AS (SELECT *, x0 + 25.0 AS x1, row_id * 14.0 + seq % 3 * 0.5 AS y0 FROM geo),
gaps AS (SELECT *, lead(x0) OVER (PARTITION BY doc_id, page, row_id ORDER BY x0, seq) - x1 AS gap FROM placed_w),
limits AS (SELECT doc_id, page, greatest(list_sort(list(gap))[len(list(gap)) // 2 + 1] * 4.0, 12.0) AS lim FROM gaps WHERE gap > 0 GROUP BY ALL),
wide_rows AS (SELECT doc_id, page, row_id, max(gap) AS gap, arg_max(x1, gap * 10000 - x1) AS x1 FROM gaps WHERE gap > 0 GROUP BY ALL),
eligible AS (SELECT doc_id, page, row_id FROM placed_w GROUP BY ALL HAVING count(*) >= 2),
centres AS (SELECT e.doc_id, e.page, CASE WHEN w.gap >= l.lim THEN w.x1 + w.gap / 2 END AS c FROM eligible e LEFT JOIN wide_rows w ON w.doc_id = e.doc_id AND w.page = e.page AND w.row_id = e.row_id LEFT JOIN limits l ON l.doc_id = e.doc_id AND l.page = e.page),
mids AS (SELECT doc_id, page, count(*) AS n, list_sort(list(c) FILTER (c IS NOT NULL))[count(c) // 2 + 1] AS mid FROM centres GROUP BY ALL),
found_g AS (SELECT c.doc_id, c.page, CASE WHEN m.n >= 3 AND count(c.c) FILTER (abs(c.c - m.mid) <= 20.0) / m.n >= 0.5 THEN avg(c.c) FILTER (abs(c.c - m.mid) <= 20.0) END AS gutter
  FROM centres c JOIN mids m ON m.doc_id = c.doc_id AND m.page = c.page GROUP BY c.doc_id, c.page, m.n),
pages_g AS (SELECT p.doc_id, p.page, g.gutter FROM (SELECT DISTINCT doc_id, page FROM placed_w) p LEFT JOIN found_g g ON g.doc_id = p.doc_id AND g.page = p.page)
"""



def _decoded(base: str) -> str:
    """CTEs ending in d_spans of a relation (doc_id, q_id, ctx) of contexts, with the derived logits."""
    return rf"""d_base AS ({base}),
d_n AS (SELECT doc_id, q_id, ctx, 7 + CAST(ceil(length(ctx) / 7.0) AS BIGINT) AS n, doc_id * 31 + q_id * 17 AS seed FROM d_base),
d_i AS (SELECT doc_id, q_id, n, seed, 6 + seed * 7 % (n - 7) AS peak, unnest(range(n)) AS i FROM d_n),
d_tok AS (SELECT doc_id, q_id, n, i, ((seed * 3 + i * (i + 5) * 7) % 64 - 40) / 8.0 + CASE WHEN i = peak THEN 16.0 ELSE 0.0 END AS s,
  ((seed * 5 + i * (i + 11) * 7) % 64 - 40) / 8.0 + CASE WHEN i = peak + seed % 40 THEN 16.0 ELSE 0.0 END AS e FROM d_i),
d_tops AS (SELECT doc_id, q_id, max(s) AS ms, max(e) AS me, max(s + e) FILTER (i = 0) AS null_score FROM d_tok GROUP BY ALL),
d_sums AS (SELECT t.doc_id, t.q_id, sum(exp(t.s - m.ms)) AS ss, sum(exp(t.e - m.me)) AS se FROM d_tok t JOIN d_tops m ON m.doc_id = t.doc_id AND m.q_id = t.q_id GROUP BY ALL),
d_wide AS (SELECT *, max(e) OVER (PARTITION BY doc_id, q_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS m FROM d_tok WHERE i BETWEEN 6 AND n - 2),
d_best AS (SELECT doc_id, q_id, arg_max(i, (s + m) * 100000 - i) AS i, arg_max(s, (s + m) * 100000 - i) AS s, arg_max(m, (s + m) * 100000 - i) AS e FROM d_wide GROUP BY ALL),
d_pair AS (SELECT b.doc_id, b.q_id, b.i, min(t.i) AS j, any_value(b.s) AS s, any_value(b.e) AS e FROM d_best b JOIN d_tok t ON t.doc_id = b.doc_id AND t.q_id = b.q_id AND t.i BETWEEN b.i AND least(b.i + 29, t.n - 2) AND t.e = b.e GROUP BY ALL),
d_cut AS (SELECT p.*, m.null_score, round(exp(p.s - m.ms) / u.ss * (exp(p.e - m.me) / u.se), 4) AS confidence, least((p.i - 6) * 7, length(ctx)) AS st, least((p.j - 6) * 7 + 7, length(ctx)) AS en, ctx
  FROM d_pair p JOIN d_tops m ON m.doc_id = p.doc_id AND m.q_id = p.q_id JOIN d_sums u ON u.doc_id = p.doc_id AND u.q_id = p.q_id JOIN d_base b ON b.doc_id = p.doc_id AND b.q_id = p.q_id),
d_raw AS (SELECT *, CASE WHEN en > st THEN substr(ctx, st + 1, en - st) ELSE '' END AS raw FROM d_cut),
d_spans AS (SELECT doc_id, q_id, i, j, s + e AS best, null_score, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS answer, st + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS char_start,
  en - (length(raw) - length(regexp_replace(raw, '\s+$', ''))) AS char_end, confidence, regexp_replace(raw, '^\s+|\s+$', '', 'g') <> '' AS found, s + e >= null_score AND confidence >= 0.05 AS accepted FROM d_raw)
"""


def _read(chosen: str) -> str:
    return (
        _ask(chosen)
        + ",\n"
        + _decoded("SELECT doc_id, q_id, ctx FROM answered WHERE length(ctx) > 0")
        + """SELECT d.doc_id, q.q_id, CASE WHEN r.accepted THEN r.answer ELSE coalesce(ans, '') END AS answer, md5(coalesce(a.ctx, '')) AS context_md5,
  CASE WHEN r.accepted THEN r.char_start WHEN ans IS NULL THEN -1 ELSE greatest(strpos(a.ctx, ans) - 1, 0) END AS char_start,
  CASE WHEN r.accepted THEN r.char_end ELSE coalesce(strpos(a.ctx, ans) - 1 + length(ans), -1) END AS char_end,
  CASE WHEN r.accepted THEN r.confidence ELSE round(coalesce(conf, 0.0), 2) END AS confidence, CASE WHEN r.accepted THEN r.found ELSE ans IS NOT NULL END AS found,
  CASE WHEN ans IS NULL THEN 0.0 ELSE 1.0 END AS retrieval_confidence, CASE WHEN ans IS NULL THEN NULL ELSE 0 END AS page_number, CAST(NULL AS VARCHAR) AS error
FROM (SELECT doc_id FROM documents) d CROSS JOIN quest q LEFT JOIN answered a ON a.doc_id = d.doc_id AND a.q_id = q.q_id LEFT JOIN d_spans r ON r.doc_id = d.doc_id AND r.q_id = q.q_id"""
    )


_IN_ORDER = """,
ordered AS (SELECT w.doc_id, w.page, w.word, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.page, coalesce(x0 >= gutter, false), y0, x0, seq) - 1 AS ord
  FROM placed_w w JOIN pages_g g ON g.doc_id = w.doc_id AND g.page = w.page WHERE w.page < 25),
offs AS (SELECT doc_id, ord, page, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM ordered)"""
_LAYOUT_ANSWERS = (
    _BOXES.rstrip()
    + _IN_ORDER
    + ",\n"
    + _ask("fast", "SELECT doc_id, string_agg(word, ' ' ORDER BY ord) AS text FROM ordered GROUP BY doc_id").removeprefix("WITH ")
    + _GROUNDING.replace("AS page_number FROM", "AS page_number, md5(h.ans) AS answer_md5 FROM")
)
_SIZES = """WITH r AS (SELECT doc_id, (n_chars % 1000) || '.5' || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END || ['B', 'kB', 'MiB', 'GB', 'KiB', 'mb', 'TB', 'x'][doc_id % 8 + 1] AS size, n_chars % 1000 + 0.5 AS v, doc_id % 8 AS u FROM documents)
SELECT doc_id, size, CAST(CASE u WHEN 0 THEN v WHEN 1 THEN v * 1000 WHEN 2 THEN v * 1048576 WHEN 3 THEN v * 1000000000 WHEN 4 THEN v * 1024 WHEN 5 THEN v * 1000000 WHEN 6 THEN v ELSE 0 END AS DOUBLE) AS n_bytes FROM r"""
SQL: dict[str, str] = {
    "page_grounding": _GROUNDED,
    "row_clusters": _BOXES + "SELECT doc_id, page, seq, row_id FROM placed_w",
    "gutter_gaps": _BOXES + "SELECT doc_id, page, count(*) AS n_gaps, max(gap) AS widest, list_sort(list(gap))[count(*) // 2 + 1] AS median_gap FROM gaps WHERE gap > 0 GROUP BY ALL",
    "gutters": _BOXES + "SELECT doc_id, page, gutter FROM pages_g",
    "column_reorder": _BOXES + """SELECT doc_id, page, md5(txt) AS text_md5, length(txt) AS n_chars FROM (SELECT w.doc_id, w.page, string_agg(word, ' ' ORDER BY coalesce(x0 >= gutter, false), y0, x0, seq) AS txt
  FROM placed_w w JOIN pages_g g ON g.doc_id = w.doc_id AND g.page = w.page WHERE w.page < 25 GROUP BY ALL)""",
    "layout_answers": _LAYOUT_ANSWERS,
    "span_decode": "WITH " + _decoded("SELECT doc_id, q_id, text AS ctx FROM documents CROSS JOIN (SELECT item_id AS q_id FROM benchmark) WHERE length(text) > 0")
    + "SELECT doc_id, q_id, i, j, best, null_score, answer, char_start, char_end, confidence, found, accepted FROM d_spans",
    "ask_reader": _read("fast"),
    "sentences": _base() + "SELECT doc_id, sent_idx, sent, char_start FROM sents",
    "windows": _base(_WINDOWS) + "SELECT doc_id, win_id, win AS window, CASE WHEN n < 3 THEN 1 ELSE 3 END AS n_sents, k AS first_sent, CASE WHEN n < 3 THEN 0 ELSE length(s0) + length(s1) + 2 END AS last_ws, length(win) AS last_we FROM wins",
    "tfidf_scores": _base(_WINDOWS, _SCORES) + "SELECT doc_id, q_id, u AS win_id, score FROM sc",
    "p40_cutoff": _DEEP + "SELECT doc_id, q_id, round(p40, 6) AS p40, max_score, n_scored FROM cutoff",
    "top8_fast": _DEEP + "SELECT doc_id, q_id, nth - 1 AS nth, win_id FROM fast",
    "pool20": _DEEP + "SELECT doc_id, q_id, nth - 1 AS nth, win_id FROM pool",
    "token_budget": _DEEP + 'SELECT doc_id, q_id, nth AS "rank", win_id, cum FROM budget',
    "ask_fast": _responses("fast"),
    "ask_rerank": _responses("budget"),
    "word_offsets": f"WITH {_WORDS}, {_OFFSETS} SELECT * FROM offs",
    "sentence_page": _PAGED + sentences(_PAGED_TEXT) + """, starts AS (SELECT doc_id, page, min(char_start) AS st FROM offs WHERE page < 25 GROUP BY ALL)
SELECT s.doc_id, s.sent_idx, s.sent, s.char_start, coalesce(p.page, 0) AS page FROM sents s ASOF LEFT JOIN starts p ON s.doc_id = p.doc_id AND s.char_start >= p.st""",
    "references_mark": f"WITH {_WORDS},\n" + sentences(_REF_TEXT) + _REFS + " SELECT * FROM marked",
    "body_filter": f"WITH {_WORDS},\n" + sentences(_REF_TEXT) + _REFS + """, kept_body AS (SELECT *, max(CASE WHEN past_references THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id) AS any_body FROM marked)
SELECT doc_id, count(*) AS n_body, max(sent_idx) AS last_sent FROM kept_body WHERE NOT past_references OR any_body = 0 GROUP BY doc_id""",
    "rerank_prune": _base(_WINDOWS) + """, r AS (SELECT doc_id, q_id, win_id, CAST((doc_id * 13 + q_id * 7 + win_id * win_id * 5) % 23 / 4.0 - doc_id % 4 * 3 AS FLOAT) AS score FROM wins CROSS JOIN (SELECT item_id AS q_id FROM benchmark)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, q_id ORDER BY score DESC, win_id) AS "rank", max(score) OVER (PARTITION BY doc_id, q_id) AS top FROM r)
SELECT doc_id, q_id, win_id, score, "rank" FROM o WHERE "rank" = 1 OR ("rank" <= 4 AND top - score <= 2.0 AND top >= -5.0)""",
    "token_f1": _base() + _PAIRS.lstrip() + " SELECT doc_id, sent_idx, retrieval_hit, exact_match, round(f1, 4) AS f1 FROM scored",
    "eval_summary": _base() + _PAIRS.lstrip() + """ SELECT 'run' || (doc_id % 3) AS label, count(*) AS total_samples, round(avg(CAST(retrieval_hit AS INT)), 4) AS recall_at_5, round(avg(CAST(exact_match AS INT)), 4) AS exact_match, round(avg(f1), 4) AS f1 FROM scored GROUP BY 1""",
    "config_sweep": _DEEP + """, runs AS (SELECT false AS use_reranker, count(*) AS n_found, sum(n) AS context_chars FROM (SELECT sum(length(win) + 1) - 1 AS n FROM fast GROUP BY doc_id, q_id)
  UNION ALL SELECT true, count(*), sum(n) FROM (SELECT sum(length(win) + 1) - 1 AS n FROM budget GROUP BY doc_id, q_id))
SELECT m.mode || CASE WHEN use_reranker THEN '+reranker' ELSE '' END AS label, m.mode AS retrieval_mode, use_reranker, n_found, context_chars FROM (VALUES ('tfidf'), ('dense'), ('hybrid')) m(mode) CROSS JOIN runs""",
    "highlight": """WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE n_chars // 4 END AS s, n_chars // 2 AS e FROM documents)
SELECT doc_id, CASE WHEN s < 0 OR e <= s THEN length(text) ELSE s END AS n_before, CASE WHEN s < 0 OR e <= s THEN '' ELSE substr(text, s + 1, e - s) END AS marked, CASE WHEN s < 0 OR e <= s THEN 0 ELSE length(text) - e END AS n_after FROM r""",
    "size_guard": f"SELECT doc_id, strlen(text) AS n_bytes, CASE WHEN strlen(text) > 4000 THEN '{TOO_LARGE}' END AS error FROM documents",
    "doc_hash": "SELECT sha256(text) AS doc_key, min(doc_id) AS first_doc, count(*) AS n_docs FROM documents GROUP BY 1",
    "question_filter": rf"""WITH q AS (SELECT item_id AS q_id, CASE WHEN item_id % 7 = 0 THEN ' ' ELSE text END AS question FROM benchmark)
SELECT q_id, len(list_filter(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({_STOP}))) AS n_tokens, 2 * len(string_split_regex({strip("question")}, '\s+')) AS n_model_tokens FROM q WHERE {strip("question")} <> ''""",
    "row_tolerance": "SELECT doc_id, page, 5.0 AS tol FROM (SELECT DISTINCT doc_id, page FROM (WITH " + _WORDS + " SELECT * FROM words))",
    "size_strings": _SIZES,
    "peak_size": f"SELECT doc_id % 7 AS run, arg_max(size, struct_pack(a := n_bytes, b := size)) AS peak, max(n_bytes) AS n_bytes FROM ({_SIZES}) GROUP BY 1",
}
