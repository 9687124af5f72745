"""The engine's queries as SQL for DuckDB, written independently of the Spark plans."""

from __future__ import annotations

from docloom.config import BANNED_EXTENSIONS, COMPARE_CONTEXTS, ERROR_CLASSES, EXPLANATORY_MARKERS, NOISE_LINES, QUERY_EXPANSIONS, STOPWORDS, SWEEP_THRESHOLDS

_WS = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _norm(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(regexp_replace({x}, '\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{_WS}]+'), lambda w: w <> '')"


def _tok(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9_/.+-]+'), lambda t: NOT list_contains({_list(STOPWORDS)}, t))"


def _terms(x: str) -> str:
    return f"list_distinct({_tok(x)})"


def _parts(x: str) -> str:
    split = rf"regexp_split_to_array(regexp_replace({_norm(x)}, '([.!?])[{_WS}]+', '\1' || chr(1), 'g'), '\x01|\n+')"
    return f"list_filter(list_transform({split}, lambda p: {_norm('p')}), lambda p: p <> '')"


def _fold(p: str) -> str:
    joined = "CASE WHEN acc.b = '' THEN e.b ELSE acc.b || ' ' || e.b END"
    hold = rf"(len({_words(joined)}) < 8 AND NOT regexp_matches(e.b, '[.!?]$'))"
    step = f"CASE WHEN {hold} THEN {{'s': acc.s, 'b': {joined}}} ELSE {{'s': list_append(acc.s, {joined}), 'b': ''}} END"
    return f"list_reduce(list_prepend({{'s': []::varchar[], 'b': ''}}, list_transform({p}, lambda x: {{'s': []::varchar[], 'b': x}})), lambda acc, e: {step})"


def _sentences(table: str, key: str, text: str, out: str = "sent", extra: str = "") -> str:
    """CTEs that end in `out` (key, extra columns, s)."""
    return f"""{out}_p AS (SELECT {key} {extra}, {_parts(text)} AS p FROM {table}),
    {out}_f AS (SELECT *, {_fold('p')} AS f FROM {out}_p),
    {out} AS (SELECT * EXCLUDE (p, f), CASE WHEN f.b = '' THEN f.s WHEN len(f.s) = 0 THEN [f.b] ELSE list_append(f.s[1:len(f.s) - 1], f.s[len(f.s)] || ' ' || f.b) END AS s FROM {out}_f)"""


_DOCS = "docs AS (SELECT * FROM crawl_docs QUALIFY row_number() OVER (PARTITION BY doc_id) = 1)"
_CHUNKS = "chunks AS (SELECT * FROM processed_chunks QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1)"


def _url(x: str) -> str:
    u = f"split_part({_strip(x)}, '#', 1)"
    scheme = rf"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"
    host = rf"lower(regexp_extract({u}, '^[^:/?]+://([^/?]*)', 1))"
    path = rf"regexp_replace(regexp_extract({u}, '^[^:/?]+://[^/?]*([^?]*)', 1), ';[^/]*$', '')"
    query = rf"regexp_extract({u}, '\?(.*)$', 1)"
    return f"{scheme} || '://' || {host} || CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


def _expand(x: str) -> str:
    extra = ", ".join(f"CASE WHEN contains(lower({x}), {_q(k)}) THEN {_q(v)} END" for k, v in QUERY_EXPANSIONS.items())
    parts = f"list_filter(list_concat([{x}, {extra}], (regexp_extract_all({x}, '[A-Za-z_][A-Za-z0-9_]*'))[1:4]), lambda p: p IS NOT NULL AND p <> '')"
    # list_distinct keeps no order, so a part stays where it first stands
    return f"array_to_string(list_filter({parts}, lambda p, i: list_position({parts}, p) = i), ' ')"


def _style(x: str) -> str:
    return f"CASE WHEN regexp_matches(lower({x}), {_q('|'.join(EXPLANATORY_MARKERS))}) THEN 'explanatory' ELSE 'extractive' END"



def _compare(x: str) -> str:
    """A term of a comparison. Word bounds: RE2 knows ASCII ones only, which the data's terms are."""
    y = f"trim(lower({_norm(x)}), ' .?')"
    y = rf"regexp_replace({y}, '\b(in|with|for|within)\s+({'|'.join(COMPARE_CONTEXTS)})\b', '', 'g')"
    y = rf"regexp_replace({y}, '(?m)\b(and|when|why|how|used|recommended|should|is each|each)\b.*$', '', 'g')"
    y = rf"regexp_replace({y}, '[^a-z0-9_./+-]+$', '')"
    return f"trim({_norm(y)}, ' .?,')"


def _pair(x: str, end: str = r",|\?|$") -> tuple[str, str, str]:
    p = rf"'difference between (.+?) and (.+?)(?:{end})'"
    return f"regexp_matches(lower({x}), {p})", _compare(f"regexp_extract(lower({x}), {p}, 1)"), _compare(f"regexp_extract(lower({x}), {p}, 2)")


def _overlap(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::double / greatest(len({a}), 1))"


_VALID = f"""asked AS (SELECT qid, {_norm('question')} AS question, coalesce(threshold, 0.01) AS threshold FROM questions WHERE qid % 20 = 0),
    valid AS (SELECT * FROM asked WHERE length(question) >= 3 AND threshold BETWEEN 0 AND 1)"""


def _bm25(questions: str, k: int = 20) -> str:
    """CTEs that end in bm25 (qid, chunk_id, rank, bm25); `questions` is a CTE with qid and question."""
    return f"""{_CHUNKS},
    toks AS (SELECT chunk_id, {_tok('chunk_text')} AS t FROM chunks),
    stats AS (SELECT count(*) AS n, sum(len(t))::double / greatest(count(*), 1) AS avgdl FROM toks),
    posts AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks),
    tf AS (SELECT term, chunk_id, dl, count(*) AS tf FROM posts GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_tok(_expand('question'))}) AS term FROM {questions}) GROUP BY ALL),
    scored AS (SELECT qid, chunk_id, round(sum(qtf * ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double) / (tf + 1.5::double * (0.25::double + 0.75::double * dl / greatest(avgdl, 1e-9)))), 6) AS bm25
        FROM qt JOIN tf USING (term) JOIN df USING (term), stats GROUP BY qid, chunk_id),
    bm25 AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, chunk_id) AS rank, bm25 FROM scored QUALIFY rank <= {k})"""


_TITLE = _terms("coalesce(title, '') || ' ' || coalesce(section_title, '')")


def _features(source: str, key: str, text: str, out: str) -> str:
    """CTE `out` (key, i, v): unit vectors of signed token counts, in single precision."""
    return f"""{out}_t AS (SELECT {key}, unnest({_tok(f"coalesce({text}, '')")}) AS t FROM {source}),
    {out}_c AS (SELECT {key}, ('0x' || md5(t)[7:8])::bigint AS i, sum(CASE WHEN md5(t)[9:9] < '8' THEN 1 ELSE -1 END)::double AS c FROM {out}_t GROUP BY ALL),
    {out}_n AS (SELECT {key}, sqrt(sum(c * c)) AS norm FROM {out}_c GROUP BY {key}),
    {out} AS (SELECT {key}, i, CASE WHEN norm > 0 THEN (c / norm)::float ELSE 0 END AS v FROM {out}_c JOIN {out}_n USING ({key}))"""


def _hybrid(questions: str) -> str:
    """CTEs that end in hybrid (qid, chunk_id, hybrid_score, question, title_terms, hybrid_rank), by BM25 and dense search."""
    return f"""{_bm25(questions)},
    tt AS (SELECT chunk_id, {_TITLE} AS title_terms FROM chunks),
    {_features('chunks', 'chunk_id', 'dense_text', 'cv')}, {_features(f'(SELECT qid, {_expand("question")} AS x FROM {questions})', 'qid', 'x', 'qv')},
    sums AS (SELECT qid, chunk_id, sum(qv.v::double * cv.v::double) AS s FROM qv JOIN cv USING (i) GROUP BY ALL),
    every AS (SELECT qid, chunk_id, round(coalesce(s, 0), 6) AS score FROM {questions} CROSS JOIN (SELECT chunk_id FROM chunks) LEFT JOIN sums USING (qid, chunk_id)),
    dense AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM every QUALIFY rank <= 20),
    fused AS (SELECT qid, chunk_id, coalesce(1.0::double / (60 + b.rank), 0) + coalesce(1.0::double / (60 + t.rank), 0) AS rrf FROM bm25 b FULL JOIN dense t USING (qid, chunk_id)),
    hs AS (SELECT f.qid, chunk_id, round(rrf + 0.1::double * {_overlap(_terms(_expand('question')), 'title_terms')}, 6) AS hybrid_score, question, title_terms FROM fused f JOIN tt USING (chunk_id) JOIN {questions} v ON v.qid = f.qid),
    hybrid AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hybrid_score DESC, chunk_id) AS hybrid_rank FROM hs QUALIFY hybrid_rank <= 20)"""


def _reranked() -> str:
    """CTE reranked over hybrid: the seven best of each question."""
    return f"""rr AS (SELECT h.*, {_overlap(_terms('question'), _terms(f"({_norm('c.chunk_text')})[1:2200]"))} AS body, {_overlap(_terms('question'), 'h.title_terms')} AS title_share FROM hybrid h JOIN chunks c ON c.chunk_id = h.chunk_id),
    rs AS (SELECT *, round(CASE WHEN body = 0 AND title_share = 0 THEN -1.0 ELSE 8.0 * body + 2.0 * title_share END, 6) AS reranker_score FROM rr),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY reranker_score DESC, chunk_id) AS rerank_rank FROM rs QUALIFY rerank_rank <= 7)"""


_HYBRID = f"{_VALID}, {_hybrid('valid')}"
_BONUS = f"""tt2 AS (SELECT chunk_id, {_TITLE} AS title_terms FROM chunks),
    bonus AS (SELECT v.qid, tt2.chunk_id, {_overlap(_terms(_expand('question')), 'title_terms')} AS share FROM valid v, tt2)"""


def _answer(x: str) -> str:
    """Articles between Unicode word bounds: words are marked first, since RE2's own bounds are ASCII."""
    marked = rf"regexp_replace(lower({x}), '([\p{{L}}\p{{N}}\p{{M}}_]+)', '<\1>', 'g')"
    # real angle brackets are punctuation and go later, with the marks
    return f"array_to_string({_words(rf'''regexp_replace(regexp_replace({marked}, '<(a|an|the)>', ' ', 'g'), '[!-/:-@\[-`{{-~]', '', 'g')''')}, ' ')"


def _f1(p: str, g: str) -> str:
    both = f"list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t)))))"
    n = f"coalesce({both}, 0)::double"
    return f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 OR {n} = 0 THEN 0.0 ELSE 2.0 * ({n} / len({p})) * ({n} / len({g})) / ({n} / len({p}) + {n} / len({g})) END"


_EXAMPLES = f"""items AS (SELECT id AS qid, question FROM eval_items), {_bm25('items', 5)},
    ev AS (SELECT b.qid, b.rank, b.bm25, b.chunk_id, coalesce(c.title, '') AS title, {_url('c.source_url')} AS url FROM bm25 b JOIN chunks c USING (chunk_id)),
    gold AS (SELECT e.qid, min(e.rank) AS first FROM ev e JOIN eval_items i ON i.id = e.qid WHERE list_contains(i.gold_chunk_ids, e.chunk_id) OR list_contains(i.gold_source_urls, e.url) GROUP BY ALL),
    top AS (SELECT * FROM ev WHERE rank = 1),
    th AS (SELECT unnest([{', '.join(f'{t}::double' for t in SWEEP_THRESHOLDS)}]) AS threshold),
    ans AS (SELECT i.*, th.threshold, coalesce(t.bm25 / 100 >= th.threshold, false) AS ok, CASE WHEN coalesce(t.bm25 / 100 >= th.threshold, false) THEN t.title ELSE '' END AS pred, t.qid IS NOT NULL AS found, g.first
        FROM eval_items i CROSS JOIN th LEFT JOIN top t ON t.qid = i.id LEFT JOIN gold g ON g.qid = i.id),
    toks2 AS (SELECT *, {_words(_answer('pred'))} AS p, list_transform(coalesce(answers, []), lambda a: {_words(_answer('a'))}) AS gs, list_transform(coalesce(required_terms, []), lambda r: {_answer('r')}) AS rs, {_answer('pred')} AS np FROM ans),
    ex AS (SELECT id, threshold, answerable, coalesce(question_type, 'extractive') AS question_type,
        CASE WHEN answerable THEN coalesce(list_bool_or(list_transform(gs, lambda g: array_to_string(g, ' ') = np)), false)::int::double ELSE (NOT ok)::int::double END AS exact_match,
        CASE WHEN answerable THEN coalesce(list_max(list_transform(gs, lambda g: {_f1('p', 'g')})), 0.0) ELSE (NOT ok)::int::double END AS f1,
        CASE WHEN answerable AND len(rs) > 0 THEN len(list_filter(rs, lambda r: contains(np, r)))::double / len(rs) ELSE 0.0 END AS coverage,
        CASE WHEN len(gold_chunk_ids) = 0 AND len(gold_source_urls) = 0 THEN (NOT found)::int::double ELSE coalesce((first <= 1)::int::double, 0.0) END AS hit_at_1,
        CASE WHEN len(gold_chunk_ids) = 0 AND len(gold_source_urls) = 0 THEN (NOT found)::int::double ELSE coalesce((first <= 3)::int::double, 0.0) END AS hit_at_3,
        CASE WHEN len(gold_chunk_ids) = 0 AND len(gold_source_urls) = 0 THEN (NOT found)::int::double ELSE coalesce(1.0 / first, 0.0) END AS mrr,
        CASE WHEN answerable THEN 0.0 ELSE (NOT ok)::int::double END AS no_answer_correct FROM toks2)"""


def _mean(c: str, who: str) -> str:
    return f"round(coalesce(avg({c}) FILTER ({who}), 0.0), 6)"


_SUMMARY = f"""summary AS (SELECT threshold, count(*) AS example_count, count(*) FILTER (answerable) AS answerable_count, count(*) FILTER (answerable AND question_type = 'explanatory') AS explanatory_count,
    count(*) FILTER (NOT answerable) AS negative_count, {_mean('exact_match', 'answerable')} AS qa_exact_match, {_mean('f1', 'answerable')} AS qa_f1,
    {_mean('f1', "answerable AND question_type = 'explanatory'")} AS explanatory_f1, {_mean('coverage', "answerable AND question_type = 'explanatory'")} AS explanatory_term_coverage,
    {_mean('hit_at_1', 'answerable')} AS retrieval_hit_at_1, {_mean('hit_at_3', 'answerable')} AS retrieval_hit_at_3, {_mean('mrr', 'answerable')} AS retrieval_mrr,
    {_mean('no_answer_correct', 'NOT answerable')} AS no_answer_accuracy, round(avg(f1), 6) AS overall_score FROM ex GROUP BY threshold)"""

_HOST = r"regexp_extract(source_url, '^[^:/?#]+://([^/?#]*)', 1)"
_PATH = r"lower(regexp_extract(source_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1))"
_HAS, _LEFT, _RIGHT = _pair("question")
_DENSE = f"concat_ws(chr(10), CASE WHEN source_name <> '' THEN 'Source: ' || source_name END, CASE WHEN title <> '' THEN 'Document: ' || title END, CASE WHEN section_title <> '' THEN 'Section: ' || section_title END, chunk_text)"
_WINDOWS = "(1 + ceil(greatest({n} - {size}, 0) / {step}))::int"

_WORD_CHUNKS = f"""w AS (SELECT doc_id, {_words(_norm('clean_text'))} AS w FROM docs),
    wc AS (SELECT doc_id, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE {_WINDOWS.format(n='len(w)', size=180, step='145.0')} END)) AS position, w FROM w),
    wchunks AS (SELECT doc_id, position, array_to_string(w[145 * position + 1 : 145 * position + 180], ' ') AS chunk FROM wc)"""

_SENTENCE_CHUNKS = f"""{_DOCS}, {_sentences('docs', 'doc_id', 'clean_text', extra=f', source_name, title, section_title, len({_words(_norm("clean_text"))}) AS n_words')}, {_WORD_CHUNKS},
    kinds AS (SELECT *, len(s) > greatest(80, n_words // 6) OR len(s) < 4 AS by_words, {_WINDOWS.format(n='len(s)', size=8, step='6.0')} AS k FROM sent),
    kept AS (SELECT *, k > 1 AND len(s) - 6 * (k - 1) < 4 AS merged FROM kinds WHERE NOT by_words),
    sw AS (SELECT doc_id, unnest(range(CASE WHEN merged THEN k - 1 ELSE k END)) AS position, s, k, merged FROM kept),
    parts AS (SELECT doc_id, position, array_to_string(s[6 * position + 1 : 6 * position + 8], ' ') || CASE WHEN merged AND position = k - 2 THEN ' ' || array_to_string(s[6 * position + 7 : 6 * position + 14], ' ') ELSE '' END AS chunk_text FROM sw
        UNION ALL SELECT doc_id, position, chunk FROM wchunks WHERE doc_id IN (SELECT doc_id FROM kinds WHERE by_words)),
    named AS (SELECT doc_id || '_chunk_' || CASE WHEN position < 1000 THEN lpad(position::varchar, 3, '0') ELSE position::varchar END AS chunk_id, p.doc_id, position, chunk_text, d.source_name, d.title, d.section_title FROM parts p JOIN docs d USING (doc_id)),
    {_sentences('named', 'chunk_id', 'chunk_text', 'cs')}"""

_LOW = "(e.reranker_score < 0 OR (e.retrieval_score < 0.02 AND e.reader_score < greatest(0.15, threshold)) OR (length(sp) <= 1 AND e.reader_score < 0.2) OR regexp_matches(sp, '^[^\\p{L}\\p{N}\\p{M}]+$') OR (regexp_matches(sp, '^[0-9]{1,4}$') AND e.reader_score < 0.2))"

_SYN_HAS, _SYN_LEFT, _SYN_RIGHT = _pair("question", r"\?|$")


def _synthesis(source: str) -> str:
    """CTEs that end in synthesis (qid, synthesis, confidence) of `source` (qid, question, r, ld, rd): support and definitions."""
    primarily = _norm("lt || ' is primarily ' || ld || ', while ' || rt || ' is primarily ' || rd || '. Use ' || lt || ' when you want ' || ld || ', and use ' || rt || ' when you want ' || rd || '.'")
    return f"""sb AS (SELECT qid, lower(question) AS low, r, coalesce(ld, '') AS ld, coalesce(rd, '') AS rd, {_SYN_HAS} AND regexp_matches(lower(question), 'difference between|compare| versus | vs ') AS cmp, {_SYN_LEFT} AS lt, {_SYN_RIGHT} AS rt FROM {source}),
        sc AS (SELECT *, list_transform(r, lambda x: x.sentence) AS s, list_transform(r, lambda x: x.score) AS sc FROM sb),
        sd AS (SELECT *, list_filter(s, lambda x: contains(lower(x), lt)) AS ls, list_filter(s, lambda x: contains(lower(x), rt)) AS rs FROM sc),
        sf AS (SELECT *, list_concat(ls[1:1], rs[1:1]) AS fst, cmp AND ld <> '' AND rd <> '' AS dual FROM sd),
        sg AS (SELECT *, CASE WHEN cmp THEN list_concat(fst, list_filter(s[1:3], lambda x: NOT list_contains(fst, x)))[1:3] ELSE s[1:3] END AS chosen,
            CASE WHEN contains(low, 'why') THEN 'Based on the documentation, ' WHEN contains(low, 'how') THEN 'According to the retrieved documentation, ' ELSE '' END AS prefix FROM sf),
        sh AS (SELECT *, {_norm("array_to_string(chosen, ' ')")} AS j FROM sg),
        synthesis AS (SELECT qid, CASE WHEN len(r) = 0 THEN '' WHEN dual THEN {primarily} WHEN cmp AND len(ls) > 0 AND len(rs) > 0 THEN {_norm("lt || ' is described as ' || trim(ls[1], '. ') || ' while ' || rt || ' is described as ' || trim(rs[1], '. ')")}
            WHEN prefix <> '' AND j <> '' THEN {_norm("prefix || lower(j[1:1]) || j[2:]")} ELSE j END AS synthesis,
            CASE WHEN len(r) = 0 THEN 0.0 WHEN dual THEN least(0.99, list_max(sc[1:2])) WHEN cmp AND len(ls) > 0 AND len(rs) > 0 THEN least(0.99, list_sum(sc[1:2]) / greatest(len(sc[1:2]), 1)) ELSE least(0.99, list_sum(sc[1:3]) / greatest(len(sc[1:3]), 1)) END AS confidence FROM sh)"""


_ASKED = f"""asked0 AS (SELECT qid::varchar AS qid, question, threshold, style FROM questions UNION ALL SELECT id, question, 0.05, answer_style FROM eval_items),
    asked AS (SELECT qid, {_norm('question')} AS question, coalesce(threshold, 0.01) AS threshold, CASE WHEN lower(style) IN ('extractive', 'explanatory') THEN lower(style) ELSE 'auto' END AS style FROM asked0),
    valid AS (SELECT * FROM asked WHERE length(question) >= 3 AND threshold BETWEEN 0 AND 1)"""


def _support(q_terms: str, sentence: str, t_terms: str, reranker: str, hybrid: str) -> str:
    """The score of a support sentence; ten places before four, so that ties of both engines fall alike."""
    return f"""CASE WHEN len({_terms(sentence)}) = 0 THEN 0.0 ELSE 0.45::double * {_overlap(q_terms, _terms(sentence))} + 0.2::double * greatest({reranker}, 0.0::double) / 10 + 0.15::double * greatest({hybrid}, 0.0::double)
        + 0.1::double * {_overlap(q_terms, t_terms)} + 0.1::double * least(len({_words(sentence)}) / 24.0::double, 1.0::double) END"""


_CMP_HAS, _CMP_LEFT, _CMP_RIGHT = _pair("question")
_ANSWERS = f"""{_ASKED}, {_hybrid('valid')}, {_reranked()},
    cand AS (SELECT r.*, c.chunk_text, c.source_url, c.title, c.section_title, ({_norm('c.chunk_text')})[1:2200] AS context, {_terms('r.question')} AS qt, v.threshold FROM reranked r JOIN chunks c USING (chunk_id) JOIN valid v ON v.qid = r.qid),
    top AS (SELECT qid, rerank_rank, chunk_id, context, question, qt, title_terms, hybrid_score, reranker_score FROM cand WHERE rerank_rank <= 5),
    {_sentences('top', 'qid', 'context', 'es', ', rerank_rank, qt')},
    eb AS (SELECT qid, rerank_rank, list_max(list_filter(list_transform(s, lambda x, i: {{'score': {_overlap('qt', _terms('x'))}, 'i': -i, 'x': x}}), lambda y: y.score > 0)) AS m FROM es),
    er AS (SELECT t.*, coalesce(m.score, 0.0) AS b, coalesce(m.x, '') AS sent, round(coalesce(m.score, 0.0) * coalesce(m.score, 0.0) * 0.6::double, 6) AS reader FROM top t JOIN eb USING (qid, rerank_rank)),
    ev AS (SELECT *, round(greatest(reader, 0.65::double * reader + 0.2::double * b + 0.15::double * {_overlap('qt', 'title_terms')}), 4) AS reader_score, CASE WHEN b >= 0.34 AND length({_norm('sent')}) < 2 THEN sent ELSE {_norm('sent')} END AS span FROM er),
    evs AS (SELECT qid, list({{'chunk_id': chunk_id, 'retrieval_score': round(hybrid_score, 4), 'reranker_score': round(reranker_score, 4), 'reader_score': reader_score, 'answer_span': span, 'preview': context[1:500]}} ORDER BY rerank_rank) AS evidence FROM ev GROUP BY qid),
    {_sentences('cand', 'qid', 'chunk_text', 'ss', ', chunk_id, rerank_rank, qt, title_terms, reranker_score, hybrid_score')},
    sp AS (SELECT * EXCLUDE (s), unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM ss),
    own AS (SELECT * FROM sp WHERE len({_words('sentence')}) >= 6 QUALIFY row_number() OVER (PARTITION BY qid, lower(sentence) ORDER BY rerank_rank, pos) = 1),
    scored_own AS (SELECT qid, sentence, round({_support('qt', 'sentence', 'title_terms', 'reranker_score', 'hybrid_score')}, 4) AS score, chunk_id, pos, rerank_rank FROM own),
    pairs AS (SELECT qid, qt, source_url, {_CMP_LEFT} AS lt, {_CMP_RIGHT} AS rt FROM cand WHERE rerank_rank <= 3 AND {_CMP_HAS}),
    urls AS (SELECT DISTINCT qid, qt, source_url, unnest([{{'side': 1, 'term': lt}}, {{'side': 2, 'term': rt}}]) AS x FROM pairs),
    held AS (SELECT u.qid, u.qt, x.side AS side, x.term AS term, c.chunk_id, c.chunk_text, {_TITLE.replace('title', 'c.title').replace('section_c.title', 'section_title')} AS title_terms FROM urls u JOIN chunks c USING (source_url) WHERE contains(lower(c.chunk_text), x.term)),
    {_sentences('held', 'qid', 'chunk_text', 'hsn', ', side, term, chunk_id, qt, title_terms')},
    hp AS (SELECT * EXCLUDE (s), unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM hsn),
    hf AS (SELECT *, lower(sentence) AS low, round({_support('qt', 'sentence', 'title_terms', '1.5', '0.04')} + 0.12::double, 4) AS score FROM hp WHERE contains(lower(sentence), term) AND NOT EXISTS (SELECT 1 FROM own o WHERE o.qid = hp.qid AND lower(o.sentence) = lower(hp.sentence))),
    lft AS (SELECT * FROM hf WHERE side = 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id, pos) = 1),
    rgt AS (SELECT * FROM hf WHERE side = 2 AND NOT EXISTS (SELECT 1 FROM lft WHERE lft.qid = hf.qid AND lft.low = hf.low) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id, pos) = 1),
    sup AS (SELECT * FROM scored_own UNION ALL SELECT qid, sentence, score, chunk_id, pos, 1000 FROM lft UNION ALL SELECT qid, sentence, score, chunk_id, pos, 1001 FROM rgt),
    sbest AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rerank_rank, pos, chunk_id) AS place FROM sup QUALIFY place <= 6),
    sups AS (SELECT qid, list({{'sentence': sentence, 'score': score}} ORDER BY place) AS r FROM sbest GROUP BY qid),
    base AS (SELECT v.*, coalesce(r, []) AS r, NULL::varchar AS ld, NULL::varchar AS rd, coalesce(evidence, []) AS evidence FROM valid v LEFT JOIN sups USING (qid) LEFT JOIN evs USING (qid)),
    {_synthesis('base')},
    da AS (SELECT b.*, synthesis, s.confidence AS support, CASE WHEN b.style <> 'auto' THEN b.style ELSE {_style('b.question')} END AS question_style, list_max(list_transform(evidence, lambda e, i: {{'s': e.reader_score, 'i': -i, 'e': e}})).e AS e FROM base b JOIN synthesis s USING (qid)),
    db AS (SELECT *, {_strip("coalesce(e.answer_span, '')")} AS sp, question_style = 'explanatory' AND synthesis <> '' AND support >= greatest(0.18, threshold) AS synth FROM da),
    dc AS (SELECT *, e.reader_score IS NULL OR e.reader_score < threshold OR {_LOW} AS none FROM db)"""


def _tens(rows: str, name: str) -> str:
    return f"array_to_string(list_transform({rows}, lambda z: round(z.{name} * 10000)::bigint), ',')"


def _joined(rows: str, name: str) -> str:
    return f"array_to_string(list_transform({rows}, lambda z: z.{name}), '|')"


_SITE = f"""{_DOCS}, numbered AS (SELECT source_name, doc_id, row_number() OVER (PARTITION BY source_name ORDER BY doc_id) - 1 AS k FROM docs JOIN sources USING (source_name)),
    pages AS (SELECT n.*, base_url || 'guide/p' || k AS url, k % 5 <> 4 AS passes FROM numbered n JOIN sources USING (source_name)),
    seen0 AS (SELECT source_name, 0 AS k, 0 AS depth FROM sources),
    seen1 AS (SELECT p.source_name, unnest(range(4 * p.k + 1, 4 * p.k + 5)) AS k, 1 AS depth FROM seen0 s JOIN pages p USING (source_name, k) WHERE passes),
    seen2 AS (SELECT p.source_name, unnest(range(4 * p.k + 1, 4 * p.k + 5)) AS k, 2 AS depth FROM seen1 s JOIN pages p USING (source_name, k) WHERE passes),
    seen AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY k) AS nth FROM (SELECT * FROM seen0 UNION ALL SELECT * FROM seen1 UNION ALL SELECT * FROM seen2)),
    queue AS (SELECT s.*, p.doc_id, p.url, p.doc_id IS NOT NULL AS fetched, coalesce(p.passes, false) AS accepted, coalesce(sum(coalesce(p.passes, false)::int) OVER (PARTITION BY s.source_name ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS filed FROM seen s LEFT JOIN pages p USING (source_name, k) WHERE nth <= 18),
    visited AS (SELECT * FROM queue WHERE filed < 12)"""

# The text of a page without main part: text nodes in order, of all elements but the dropped ones and scripts.
_BARE = r"html"
for _tag in ("nav", "header", "footer", "aside"):
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_tag}\b.*?</{_tag}>', '', 'g')"
_UNESCAPE = "replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_NODES = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace({_BARE}, '(?is)<(script|style)\b.*?</(script|style)>', '', 'g'), '<[^>]*>'), lambda x: {_strip(_UNESCAPE.format(x='x'))}), lambda x: x <> '')"
_LINES = f"list_filter(list_transform(string_split({_norm(f'array_to_string({_NODES}, chr(10))')}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '' AND NOT list_contains({_list(NOISE_LINES)}, lower(x)))"

ORACLES = {
    "normalized_text": f"WITH {_DOCS} SELECT doc_id, length({_norm('clean_text')}) AS n_chars, md5({_norm('clean_text')}) AS text_md5 FROM docs",
    "token_lists": f"WITH {_DOCS} SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tok('clean_text')} AS t FROM docs)",
    "sentence_lists": f"WITH {_DOCS}, {_sentences('docs', 'doc_id', 'clean_text')} SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM sent",
    "question_styles": f"SELECT qid, {_style('question')} AS question_style, {_expand('question')} AS expanded, CASE WHEN {_HAS} THEN {_LEFT} ELSE '' END AS left_term, CASE WHEN {_HAS} THEN {_RIGHT} ELSE '' END AS right_term FROM questions WHERE question IS NOT NULL",
    "url_forms": f"SELECT source_name, source_url, {_url('source_url')} AS url, replace(lower(source_name), ' ', '_') || '_' || sha1({_url('source_url')})[1:12] AS url_doc_id FROM (SELECT DISTINCT source_name, source_url FROM crawl_docs)",
    "url_validity": f"SELECT source_url, regexp_matches(source_url, '^https?://') AND contains({_HOST}, allowed_netloc) AND NOT regexp_matches({_PATH}, '({'|'.join(e.replace('.', chr(92) + '.') for e in BANNED_EXTENSIONS)})$') AND coalesce(list_bool_or(list_transform(allow_patterns, lambda p: regexp_matches(source_url, p))), false) AS valid FROM (SELECT DISTINCT source_name, source_url FROM crawl_docs) JOIN sources USING (source_name)",
    "first_pages": f"WITH {_DOCS} SELECT doc_id, source_url FROM docs QUALIFY row_number() OVER (PARTITION BY {_url('source_url')} ORDER BY crawl_depth NULLS LAST, doc_id) = 1",
    "quality_gate": f"WITH {_DOCS} SELECT doc_id, length(clean_text) >= 140 AND len({_words('clean_text')}) >= 40 AS passed FROM docs",
    "word_chunks": f"WITH {_DOCS}, {_WORD_CHUNKS} SELECT doc_id, position::int AS position, md5(chunk) AS chunk_md5 FROM wchunks",
    "sentence_chunks": f"WITH {_SENTENCE_CHUNKS} SELECT chunk_id, doc_id, position::int AS position_in_doc, len({_tok('chunk_text')}) AS token_length, len(s) AS sentence_count, md5(chunk_text) AS chunk_md5, md5({_strip(_DENSE)}) AS dense_md5 FROM named JOIN cs USING (chunk_id)",
    "dense_texts": f"WITH {_CHUNKS} SELECT chunk_id, md5({_strip(_DENSE)}) AS dense_md5 FROM chunks",
    "document_frequency": f"WITH {_CHUNKS} SELECT term, count(*) AS df FROM (SELECT unnest({_terms('chunk_text')}) AS term FROM chunks) GROUP BY term",
    "corpus_statistics": f"WITH {_CHUNKS} SELECT count(*) AS n, round(sum(len({_tok('chunk_text')}))::double / greatest(count(*), 1), 6) AS avgdl FROM chunks",
    "bm25_topk": f"WITH {_VALID}, {_bm25('valid')} SELECT qid, chunk_id, rank, bm25 FROM bm25",
    "dense_topk": "SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank, score FROM (SELECT q.vec_id AS qid, v.vec_id, round(list_inner_product(q.embedding::double[], v.embedding::double[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) QUALIFY rank <= 20",
    "bm25_scores": f"WITH {_VALID}, {_bm25('valid')}, {_BONUS} SELECT qid, chunk_id, rank, round(bm25 + 0.15::double * share, 6) AS score FROM bm25 JOIN bonus USING (qid, chunk_id)",
    "dense_chunks": f"WITH {_HYBRID}, {_BONUS} SELECT qid, chunk_id, rank, round(score + 0.1::double * share, 6) AS score FROM dense JOIN bonus USING (qid, chunk_id)",
    "hybrid_rrf": f"WITH {_HYBRID} SELECT qid, chunk_id, hybrid_rank, hybrid_score FROM hybrid",
    "rerank_topk": f"WITH {_HYBRID}, {_reranked()} SELECT qid, chunk_id, rerank_rank, reranker_score FROM reranked",
    "best_sentences": f"""WITH a AS (SELECT qid, question, unnest(range(len(evidence))) AS place, evidence FROM answers QUALIFY row_number() OVER (PARTITION BY qid) >= 1),
        b AS (SELECT DISTINCT qid, place::int AS place, question, evidence[place + 1].context_preview AS ctx FROM a), {_sentences('b', 'qid', 'ctx', extra=', place, question')},
        scored AS (SELECT qid, place, list_transform(s, lambda x, i: {{'score': {_overlap(_terms('question'), _terms('x'))}, 'i': -i, 'x': x}}) AS r FROM sent),
        best AS (SELECT qid, place, list_max(list_filter(r, lambda y: y.score > 0)) AS m FROM scored)
        SELECT qid, place, round(coalesce(m.score, 0.0), 6) AS score, coalesce(m.x, '') AS sentence FROM best""",
    "span_search": """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::double * x::double, 9)) AS s FROM embeddings),
        e AS (SELECT vec_id, unnest(range(len(s))) AS i, s FROM p), v AS (SELECT vec_id, i, s[i + 1] AS sp, s[len(s) - i] AS ep FROM e),
        st AS (SELECT vec_id, i, sp, row_number() OVER (PARTITION BY vec_id ORDER BY sp DESC, i) AS r FROM v QUALIFY r <= 12), en AS (SELECT vec_id, i, ep, row_number() OVER (PARTITION BY vec_id ORDER BY ep DESC, i) AS r FROM v QUALIFY r <= 12)
        SELECT vec_id, round(st.sp * en.ep, 9) AS score, st.i::int AS first, en.i::int AS last FROM st JOIN en USING (vec_id) WHERE en.i >= st.i AND en.i - st.i <= 30 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY st.sp * en.ep DESC, st.r, en.r) = 1""",
    "answer_decisions": f"""WITH a AS (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY qid) = 1),
        b AS (SELECT a.*, coalesce(q.threshold, 0.01) AS threshold, list_max(list_transform(evidence, lambda e, i: {{'s': e.reader_score, 'i': -i, 'e': e}})).e AS e, coalesce(support_sentences[1].score, 0.0) AS support FROM a JOIN questions q USING (qid)),
        c AS (SELECT *, {_strip("coalesce(e.answer_span, '')")} AS sp, question_style = 'explanatory' AND coalesce(final_answer, '') <> '' AND support >= greatest(0.18, threshold) AS synth FROM b),
        d AS (SELECT *, e.reader_score IS NULL OR e.reader_score < threshold OR {_LOW} AS none FROM c)
        SELECT qid, CASE WHEN coalesce(synth, false) THEN 'answer' WHEN none THEN 'no_answer' ELSE 'answer' END AS decided_type, CASE WHEN coalesce(synth, false) THEN final_answer WHEN none THEN '' ELSE e.answer_span END AS decided_answer,
        round(CASE WHEN coalesce(synth, false) THEN round(support, 4) WHEN none THEN 0.0 ELSE e.reader_score END, 4) AS decided_confidence FROM d""",
    "syntheses": f"""WITH a AS (SELECT qid, question, coalesce(support_sentences, []) AS r, CASE WHEN qid % 2 = 1 THEN coalesce(support_sentences[1].title, '') END AS ld, CASE WHEN qid % 2 = 1 THEN coalesce(support_sentences[1].section_title, '') END AS rd FROM answers WHERE question IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid) = 1),
        {_synthesis('a')} SELECT qid, synthesis, round(confidence, 6) AS confidence FROM synthesis""",
    "answer_metrics": f"""WITH t AS (SELECT id, {_answer('passage')} AS np, {_words(_answer('passage'))} AS p, list_transform(coalesce(answers, []), lambda a: {_words(_answer('a'))}) AS gs, list_transform(coalesce(required_terms, []), lambda r: {_answer('r')}) AS rs FROM eval_items JOIN eval_passages ON id = item_id)
        SELECT id, coalesce(list_bool_or(list_transform(gs, lambda g: array_to_string(g, ' ') = np)), false)::int::double AS exact_match, round(coalesce(list_max(list_transform(gs, lambda g: {_f1('p', 'g')})), 0.0), 6) AS f1,
        round(CASE WHEN len(rs) > 0 THEN len(list_filter(rs, lambda r: contains(np, r)))::double / len(rs) ELSE 0.0 END, 6) AS coverage, md5(np) AS normalized_md5 FROM t""",
    "evaluation_rows": f"WITH {_EXAMPLES} SELECT id, threshold, answerable, round(exact_match, 6) AS exact_match, round(f1, 6) AS f1, hit_at_1, hit_at_3, round(mrr, 6) AS mrr, no_answer_correct FROM ex",
    "evaluation_summary": f"WITH {_EXAMPLES}, {_SUMMARY} SELECT * FROM summary",
    "best_threshold": f"WITH {_EXAMPLES}, {_SUMMARY} SELECT threshold, qa_f1 FROM summary ORDER BY qa_f1 DESC, threshold LIMIT 1",
    "error_classes": f"""WITH {_EXAMPLES}, c AS (SELECT CASE WHEN NOT answerable AND no_answer_correct < 1 THEN 'false_positive' WHEN answerable AND hit_at_1 < 1 THEN 'retrieval_miss' WHEN answerable AND f1 < 1 THEN 'reader_or_span_issue' ELSE 'ok' END AS error_class FROM ex WHERE threshold = 0)
        SELECT k.error_class, count(c.error_class) AS examples FROM (SELECT unnest({_list(ERROR_CLASSES)}) AS error_class) k LEFT JOIN c USING (error_class) GROUP BY ALL""",
    "crawl_report": f"""WITH u AS (SELECT source_name, {_url('source_url')} AS url, max(coalesce(http_status = 200 AND contains(content_type, 'text/html'), false)) AS ok, max(coalesce(accepted, false)) AS accepted FROM crawl_fetches GROUP BY ALL)
        SELECT source_name, count(*) AS visited, count(*) FILTER (ok) AS fetched, count(*) FILTER (accepted) AS accepted FROM u GROUP BY source_name""",
    "daily_fetches": """WITH o AS (SELECT * FROM crawl_fetches QUALIFY row_number() OVER (PARTITION BY fetch_id) = 1)
        SELECT source_name, date_trunc('day', fetched_at) AS window_start, count(*) AS fetches, count(*) FILTER (coalesce(accepted, false)) AS accepted FROM o GROUP BY ALL""",
    "gold_pairs": f"""WITH {_CHUNKS}, u AS (SELECT DISTINCT id, question, unnest(gold_source_urls) AS source_url FROM eval_items WHERE answerable),
        g AS (SELECT id, question AS query, u.source_url, dense_text, row_number() OVER (PARTITION BY id ORDER BY chunk_id) AS nth FROM u JOIN chunks c ON {_url('c.source_url')} = u.source_url QUALIFY nth <= 3)
        SELECT query, source_url, md5(dense_text) AS positive_md5, 'gold_eval' AS kind FROM g QUALIFY row_number() OVER (PARTITION BY query, source_url ORDER BY id, nth) = 1""",
    "training_pairs": f"""WITH {_CHUNKS}, u AS (SELECT DISTINCT id, question, unnest(gold_source_urls) AS source_url FROM eval_items WHERE answerable),
        g AS (SELECT id, question AS query, u.source_url, dense_text, row_number() OVER (PARTITION BY id ORDER BY chunk_id) AS nth FROM u JOIN chunks c ON {_url('c.source_url')} = u.source_url QUALIFY nth <= 3),
        h AS (SELECT *, md5('7|' || chunk_id) AS h FROM chunks ORDER BY h, chunk_id LIMIT 120),
        s AS (SELECT unnest(['What does ' || trim(coalesce(title, '')) || ' explain in ' || trim(coalesce(source_name, '')) || '?', 'What is covered in the section ' || trim(coalesce(section_title, '')) || '?']) AS query, unnest([0, 1]) AS n, {_url('source_url')} AS source_url, dense_text, h, chunk_id FROM h),
        p AS (SELECT query, source_url, dense_text, 'gold_eval' AS kind, '1' || ' ' || id || ' ' || lpad(nth::varchar, 6, '0') AS place FROM g UNION ALL SELECT query, source_url, dense_text, 'synthetic_title_section', '2 ' || h || ' ' || chunk_id || ' ' || n FROM s)
        SELECT query, source_url, md5(dense_text) AS positive_md5, kind FROM p QUALIFY row_number() OVER (PARTITION BY query, source_url ORDER BY place) = 1""",
    "page_extract": f"""WITH p AS (SELECT raw_file_path, source_url, html FROM raw_pages QUALIFY row_number() OVER (PARTITION BY raw_file_path) = 1),
        x AS (SELECT raw_file_path, {_url('source_url')} AS url, {_norm(_UNESCAPE.format(x="regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))} AS title, {_norm(_UNESCAPE.format(x=f"regexp_extract({_BARE}, '(?is)<h2>(.*?)</h2>', 1)"))} AS section_title,
            {_norm(f"array_to_string({_LINES}, chr(10))")} AS t, len(regexp_extract_all(html, '<a href=')) AS n_links FROM p)
        SELECT raw_file_path, url, CASE WHEN title = '' THEN 'Untitled' ELSE title END AS title, section_title, length(t) AS n_chars, md5(t) AS text_md5, n_links::int AS n_links FROM x""",
    "page_links": f"WITH {_SITE}, l AS (SELECT p.url, base_url || 'guide/p' || unnest(range(4 * k + 1, 4 * k + 5)) AS link FROM pages p JOIN sources USING (source_name)) SELECT url, link FROM l",
    "crawl_documents": f"""WITH {_SITE} SELECT replace(lower(source_name), ' ', '_') || '_' || sha1(url)[1:12] AS doc_id, source_name, url AS source_url, doc_id AS title, 'Page ' || k AS section_title, md5('Page ' || k || chr(10) || 'page of ' || doc_id || repeat(' with some words', 30)) AS text_md5,
        depth AS crawl_depth, replace(lower(source_name), ' ', '_') || '_' || lpad(filed::varchar, 4, '0') || '.html' AS raw_file_path FROM visited WHERE accepted""",
    "crawl_visits": f"WITH {_SITE} SELECT source_name, count(v.k) AS visited, count(*) FILTER (fetched) AS fetched, count(*) FILTER (accepted) AS accepted FROM sources LEFT JOIN visited v USING (source_name) GROUP BY source_name",
    "term_definitions": rf"""WITH {_DOCS}, {_CHUNKS}, w AS (SELECT doc_id AS qid, source_url AS own_url, lower(regexp_extract(clean_text, '([a-zA-Z_.()]+) is read\b', 1)) AS term FROM docs),
        low AS (SELECT chunk_id, source_url, regexp_split_to_array(lower({_norm('chunk_text')}), '[{_WS}]+is[{_WS}]+read[{_WS}]+') AS p FROM chunks WHERE contains(lower(chunk_text), 'read')),
        o AS (SELECT chunk_id, source_url, unnest(range(1, len(p))) AS nr, p FROM low WHERE len(p) > 1),
        d AS (SELECT chunk_id, source_url, nr, p[nr] AS before, {_norm("split_part(array_to_string(p[nr + 1:], ' is read '), '.', 1)")} AS definition FROM o),
        m AS (SELECT qid, term, definition, row_number() OVER (PARTITION BY qid, term ORDER BY source_url <> own_url, chunk_id, NOT ends_with(before, '.' || term), nr) AS nth FROM w JOIN d ON ends_with(before, term) WHERE term <> '' AND definition <> '')
        SELECT qid, term, definition FROM m WHERE nth = 1""",
    "answer_batch": f"""WITH {_ANSWERS} SELECT qid, question, question_style, CASE WHEN synth THEN 'answer' WHEN none THEN 'no_answer' ELSE 'answer' END AS answer_type, md5(CASE WHEN synth THEN synthesis WHEN none THEN '' ELSE e.answer_span END) AS answer_md5,
        round(CASE WHEN synth THEN round(support, 4) WHEN none THEN 0.0 ELSE e.reader_score END * 10000)::bigint AS confidence, array_to_string(list_transform(evidence, lambda z: z.chunk_id), ',') AS evidence,
        {_tens('evidence', 'retrieval_score')} AS retrieval, {_tens('evidence', 'reranker_score')} AS reranker, {_tens('evidence', 'reader_score')} AS reader, md5({_joined('evidence', 'answer_span')}) AS spans_md5, md5({_joined('evidence', 'preview')}) AS previews_md5,
        md5({_joined('r', 'sentence')}) AS support_md5, {_tens('r', 'score')} AS support FROM dc""",
    "known_pairs": "SELECT query, source_url, md5(positive) AS positive_md5, kind FROM training_pairs QUALIFY row_number() OVER (PARTITION BY query, source_url ORDER BY positive) = 1",
}
