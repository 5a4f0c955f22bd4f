"""DuckDB SQL that says the same as the registered queries."""

from __future__ import annotations

from paralex.functions.prompts import EXAMPLES, INSTRUCTION, SFT
from paralex.functions.text import SPACE, WORD
from paralex.operators.books import NT_BOOKS
from paralex.plans.registry import SRC, TGT
from paralex.sources.adapters import CODES


def text(value: str) -> str:
    """A literal, line ends included."""
    return "'" + value.replace("'", "''") + "'"


NT = ", ".join(map(text, NT_BOOKS))
P = f"""p AS (
  SELECT ([{', '.join(map(text, CODES))}])[CAST((u.conv_id * 5) % {len(CODES)} AS INT) + 1] || '_' || u.conv_id || '_' || u.turn AS verse_id,
    u.text AS text_source, a.text AS text_target, u.conv_id, u.turn
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def tokens(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, {text(SPACE + '+')}), lambda x: x <> '')"


def words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), {text(WORD)})"


def strip(column: str) -> str:
    return f"regexp_replace({column}, {text(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


B = f"{P}, b AS (SELECT *, split_part(verse_id, '_', 1) AS book FROM p)"
M = f"{B}, m AS (SELECT *, book || ' ' || conv_id || ':' || turn AS ref0 FROM b)"
H = f"""{B}, h AS (SELECT *, array_to_string(list_filter({tokens('text_target')}, lambda x, i: (i - 1) % 5 <> 4), ' ') AS prediction FROM b)"""
SPLIT = f"""{B}, pool AS (
  SELECT verse_id, row_number() OVER (ORDER BY md5('41|' || verse_id), verse_id) AS r, count(*) OVER () AS n FROM b WHERE book IN ({NT})),
s AS (SELECT b.*, CASE WHEN pool.r IS NULL THEN 'test' WHEN pool.r <= ceil(CAST(0.1 AS DOUBLE) * pool.n) THEN 'validation' ELSE 'train' END AS split
  FROM b LEFT JOIN pool USING (verse_id))"""


def with_(parts: str, select: str) -> str:
    return f"WITH {parts}\n{select}"


def tokens_13a(column: str) -> str:
    out = column
    for old, new in ((r"<skipped>", ""), (r"-\n", ""), (r"\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"regexp_replace({out}, {text(old)}, {text(new)}, 'g')"
    out = f"(' ' || {out} || ' ')"
    for old, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, {text(old)}, {text(new)}, 'g')"
    return tokens(out)


def metric(rows: str) -> str:
    """CTEs ``bleu`` and ``chrf`` (grp, score) over ``rows`` (grp, prediction, target)."""
    return f"""rows_ AS (SELECT row_number() OVER () AS id, grp, {strip('prediction')} AS pr, {strip('target')} AS re FROM ({rows})),
bt AS MATERIALIZED (SELECT id, grp, {tokens_13a('pr')} AS p, {tokens_13a('re')} AS r FROM rows_),
bn AS (SELECT id, grp, n, side, unnest(list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i:i + n - 1], ' '))) AS g
  FROM (SELECT id, grp, 'p' AS side, p AS t FROM bt UNION ALL SELECT id, grp, 'r', r FROM bt), (SELECT unnest(range(1, 5)) AS n)),
bg AS (SELECT id, grp, n, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM bn GROUP BY ALL),
bs AS (SELECT k.grp, k.n, coalesce(sum(least(p, r)), 0) AS m, coalesce(sum(p), 0) AS hyp, coalesce(sum(r), 0) AS ref
  FROM (SELECT DISTINCT grp, n FROM rows_, (SELECT unnest(range(1, 5)) AS n)) k LEFT JOIN bg ON bg.grp = k.grp AND bg.n = k.n GROUP BY ALL),
bp AS (SELECT *, CASE WHEN m > 0 THEN 100.0 * m / hyp ELSE 100.0 / (pow(2, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY n)) * nullif(hyp, 0)) END AS pn FROM bs),
bleu AS (SELECT grp, round(CASE WHEN sum(m) = 0 OR min(hyp) = 0 THEN 0.0 ELSE
  (CASE WHEN max(hyp) FILTER (n = 1) >= max(ref) FILTER (n = 1) THEN 1.0 ELSE exp(1.0 - (max(ref) FILTER (n = 1))::DOUBLE / max(hyp) FILTER (n = 1)) END) * exp(avg(ln(pn))) END, 4)::DOUBLE AS bleu
  FROM bp GROUP BY grp),
ct AS MATERIALIZED (SELECT id, grp, regexp_replace(pr, {text(SPACE)}, '', 'g') AS p, regexp_replace(re, {text(SPACE)}, '', 'g') AS r FROM rows_),
cn AS (SELECT id, grp, n, side, unnest(list_transform(range(1, greatest(length(t) - n + 2, 1)), lambda i: substring(t, i, n))) AS g
  FROM (SELECT id, grp, 'p' AS side, p AS t FROM ct UNION ALL SELECT id, grp, 'r', r FROM ct), (SELECT unnest(range(1, 7)) AS n)),
cg AS (SELECT id, grp, n, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM cn GROUP BY ALL),
cr AS (SELECT id, grp, n, sum(least(p, r)) AS m, sum(p) AS hyp, sum(r) AS ref FROM cg GROUP BY ALL),
cs AS (SELECT grp, n, sum(m) AS m, sum(CASE WHEN ref > 0 THEN hyp ELSE 0 END) AS hyp, sum(ref) AS ref FROM cr GROUP BY ALL),
cf AS (SELECT grp, avg(m::DOUBLE / hyp) AS pp, avg(m::DOUBLE / ref) AS rr FROM cs WHERE hyp > 0 AND ref > 0 GROUP BY grp),
chrf AS (SELECT k.grp, round(coalesce(100.0 * 5.0 * pp * rr / nullif(4.0 * pp + rr, 0), 0), 4)::DOUBLE AS chrf
  FROM (SELECT DISTINCT grp FROM rows_) k LEFT JOIN cf ON cf.grp = k.grp)"""


def postings(name: str, source: str, key: str, cut: str) -> str:
    return f"""{name}_t AS MATERIALIZED (SELECT {key} AS k, {cut} AS t FROM {source}),
{name} AS MATERIALIZED (SELECT k, len(t) AS dl, u.term, count(*) AS tf FROM {name}_t, unnest(t) AS u(term) GROUP BY ALL)"""


def bm25_idf(name: str) -> str:
    """CTE ``{name}_idf`` (term, df, idf) and ``{name}_raw``."""
    return f"""{name}_raw AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT count(*) FROM {name}_t) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw FROM {name} GROUP BY term),
{name}_idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM {name}_raw) ELSE raw END AS idf FROM {name}_raw)"""


def tfidf(name: str, corpus: str) -> str:
    return f"""{name}_w AS MATERIALIZED (SELECT k, term, w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS w FROM (
  SELECT k, {name}.term, tf * idf AS w FROM {name} JOIN {corpus}_idf i ON i.term = {name}.term))"""


def tfidf_idf(name: str) -> str:
    return f"""{name}_idf AS MATERIALIZED (SELECT term, count(*) AS df, ln((1.0::DOUBLE + (SELECT count(*) FROM {name}_t)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf FROM {name} GROUP BY term)"""


def ranked(parts: str, queries: str, corpus: str, k: int = 5) -> str:
    """CTE ``top`` (q, rank, k, score) from ``parts`` (q, k, part), all documents competing."""
    return f"""top AS (SELECT * FROM (SELECT q, row_number() OVER (PARTITION BY q ORDER BY score DESC, k DESC) AS rank, k, score FROM (
  SELECT q, k, round(coalesce(s, 0), 6)::DOUBLE AS score FROM (SELECT k AS q FROM {queries}) CROSS JOIN (SELECT k FROM {corpus})
  LEFT JOIN (SELECT q, k, sum(part) AS s FROM ({parts}) GROUP BY ALL) USING (q, k))) WHERE rank <= {k})"""


def bm25_parts(corpus: str, queries: str) -> str:
    return f"""SELECT a.k AS q, c.k AS k, a.tf * i.idf * c.tf * 2.5::DOUBLE / (c.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * c.dl / (SELECT avg(len(t)) FROM {corpus}_t))) AS part
  FROM {queries} a JOIN {corpus} c ON a.term = c.term JOIN {corpus}_idf i ON i.term = c.term"""


DOCS_WS = postings("d", "documents", "doc_id", tokens("text"))
DOCS_WORDS = postings("d", "documents", "doc_id", words("text"))
INTRO = INSTRUCTION.format(src=SRC, tgt=TGT)
QUESTION = f"{text(chr(10) * 2 + SRC + ': ')} || text_source || {text(chr(10) + TGT + ':')}"
FEW = f"""{SPLIT},
tr AS (SELECT * FROM s WHERE split = 'train'), te AS (SELECT * FROM s WHERE split = 'test'),
{postings('d', 'tr', 'verse_id', tokens('text_source'))}, {postings('a', 'te', 'verse_id', tokens('text_source'))}, {bm25_idf('d')},
{ranked(bm25_parts('d', 'a'), 'a_t', 'd_t')},
ex AS (SELECT q, string_agg({text(SRC + ': ')} || tr.text_source || {text(chr(10) + TGT + ': ')} || tr.text_target, {text(chr(10) * 2)} ORDER BY rank) AS e FROM top JOIN tr ON tr.verse_id = top.k GROUP BY q)"""
DAILY = "daily AS (SELECT datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS step, round(avg(value), 6) AS metric FROM events GROUP BY 1)"
SFT_TEXT = f"{text(SFT.format(src=SRC, tgt=TGT))} || text_source"
ID_LIST = f"list_transform({tokens('text_target')}, lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN -100 ELSE length(x) END)"
GOOD = "CAST(json_object('translation', text_target) AS VARCHAR)"
KINDS = [
    GOOD, f"{GOOD} || ' indeed'", text("{'translation': 'x'}"), text('{"translation": null}'), text('{"translation": 5}'), text('{"other": "x"}'),
    f"{text('```json' + chr(10))} || {GOOD} || {text(chr(10) + '```')}", "substring(text_target, 1, 20)", "''", text('["translation"]'), text('{"translation": "cut'),
]
ANSWER = f"CASE (conv_id + turn) % {len(KINDS)} " + " ".join(f"WHEN {i} THEN {k}" for i, k in enumerate(KINDS)) + " END"
H_ROWS = "SELECT 1 AS grp, prediction, text_target AS target FROM h"


def explode(column: str, cut: str, source: str) -> str:
    return f"SELECT {column}, CAST(i - 1 AS INT) AS pos, t[i] AS token FROM (SELECT {column}, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT {column}, {cut} AS t FROM {source}))"


def gram_counts(orders: int, source: str, make: str, size: str) -> str:
    return f"""SELECT CAST(n AS INT) AS n, gram, count(*) AS count FROM (
  SELECT n, unnest(list_transform(range(1, greatest({size} - n + 2, 1)), lambda i: {make})) AS gram FROM ({source}), (SELECT unnest(range(1, {orders + 1})) AS n)) GROUP BY ALL"""


SQL: dict[str, str] = {
    "scan_parallel": with_(M, "SELECT ref0, 'src' AS lang0, 'tgt' AS lang1, text_source AS text0, text_target AS text1 FROM m"),
    "scan_tagged": with_(P, "SELECT verse_id, text_source, text_target FROM p WHERE turn % 4 = 0"),
    "union_splits": with_(P, "SELECT verse_id, conv_id % 3 AS part FROM p"),
    "select_split": with_(SPLIT, "SELECT verse_id, split FROM s WHERE split = 'validation'"),
    "extract_pair": with_(M, "SELECT conv_id, turn, text_source, text_target FROM m"),
    "ref_to_book": with_(M, "SELECT ref0 AS verse_id, split_part(ref0, ' ', 1) AS book FROM m"),
    "verse_to_book": with_(B, "SELECT verse_id, book FROM b"),
    "select_columns": with_(P, "SELECT text_source, text_target FROM p"),
    "map_replace_columns": with_(P, f"SELECT {text('<|user|>' + chr(10))} || {SFT_TEXT} || {text(chr(10) + '<|assistant|>' + chr(10))} || text_target || {text(chr(10))} AS text FROM p"),
    "rename_target": with_(H, "SELECT verse_id, prediction, text_target AS target FROM h"),
    "filter_in_books": with_(B, f"SELECT verse_id, book FROM b WHERE book IN ({NT})"),
    "filter_not_in_books": with_(B, f"SELECT verse_id, book FROM b WHERE book NOT IN ({NT})"),
    "filter_book": with_(B, "SELECT verse_id, book FROM b WHERE book = 'ROM'"),
    "filter_laid_out": with_(SPLIT, "SELECT verse_id, text_source, split, book FROM s WHERE split = 'train' AND book = 'ROM'"),
    "filter_book_optional": with_(B, "SELECT 'None' AS given, count(*) AS n FROM b UNION ALL SELECT '', count(*) FROM b UNION ALL SELECT 'MRK', count(*) FROM b WHERE book = 'MRK'"),
    "dispatch_model": "SELECT doc_id, (['gemini-x', 'gpt-x', 'gpt-gemini-x'])[doc_id % 3 + 1] AS model, (['gemini', 'gpt', 'gemini'])[doc_id % 3 + 1] AS provider FROM documents",
    "missing_tokens": f"SELECT token FROM (VALUES ('the'), ('of'), ('ind_Latn'), ('ptu_Latn'), ('und')) v(token) WHERE token NOT IN (SELECT unnest({tokens('text')}) FROM documents)",
    "train_val_split": with_(SPLIT, "SELECT verse_id, split FROM s WHERE split <> 'test'"),
    "assign_splits": with_(SPLIT, "SELECT verse_id, book, split FROM s"),
    "split_counts": with_(SPLIT, "SELECT split, count(*) AS n FROM s GROUP BY split"),
    "tfidf_idf": with_(f"{DOCS_WORDS}, {tfidf_idf('d')}", "SELECT term, df, round(idf, 6) AS idf FROM d_idf"),
    "tfidf_weights": with_(f"{DOCS_WORDS}, {tfidf_idf('d')}, {tfidf('d', 'd')}", "SELECT k AS doc_id, term, round(w, 6) AS weight FROM d_w"),
    "bm25_idf": with_(f"{DOCS_WS}, {bm25_idf('d')}", "SELECT term, df, round(idf, 6) AS idf FROM d_idf"),
    "bm25_corpus_stats": with_(
        f"{DOCS_WS}, {bm25_idf('d')}",
        "SELECT (SELECT count(*) FROM d_t) AS n_docs, CAST((SELECT sum(len(t)) FROM d_t) AS BIGINT) AS n_tokens, round((SELECT avg(len(t)) FROM d_t), 6) AS avgdl, count(*) AS vocabulary, round(avg(raw), 6) AS avg_idf FROM d_raw",
    ),
    "mean_embedding": "SELECT CAST(i - 1 AS INT) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i",
    "init_new_embeddings": """WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
m AS (SELECT i, avg(v) AS v FROM e GROUP BY i)
SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(v, 6) AS value FROM (SELECT * FROM e UNION ALL SELECT CAST(n AS BIGINT), i, v FROM m, (VALUES (-1), (-2)) x(n))""",
    "best_checkpoint": with_(DAILY, "SELECT step, metric FROM daily ORDER BY metric DESC, step LIMIT 1"),
    "early_stop_step": with_(
        f"""{DAILY}, w AS (SELECT *, max(metric) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM daily),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR metric > before THEN 1 ELSE 0 END) OVER (ORDER BY step) AS run FROM w),
k AS (SELECT step, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS waited FROM g)""",
        "SELECT step, waited FROM k WHERE waited >= 3 ORDER BY step LIMIT 1",
    ),
    "topk_tfidf": with_(
        f"""{DOCS_WORDS}, {tfidf_idf('d')}, {tfidf('d', 'd')}, {postings('a', 'benchmark', 'item_id', words('text'))}, {tfidf('a', 'd')},
{ranked('SELECT a_w.k AS q, d_w.k AS k, a_w.w * d_w.w AS part FROM a_w JOIN d_w USING (term)', 'a_t', 'd_t')}""",
        "SELECT q AS item_id, CAST(rank AS INT) AS rank, k AS doc_id, score FROM top",
    ),
    "topk_bm25": with_(
        f"{DOCS_WS}, {bm25_idf('d')}, {postings('a', 'benchmark', 'item_id', tokens('text'))}, {ranked(bm25_parts('d', 'a'), 'a_t', 'd_t')}",
        "SELECT q AS item_id, CAST(rank AS INT) AS rank, k AS doc_id, score FROM top",
    ),
    "topk_dense": """SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id DESC) AS rank FROM (
SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= 5""",
    "dot_product": "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "fewshot_prompts": with_(FEW, f"SELECT verse_id, {text(INTRO)} || coalesce({text(EXAMPLES)} || e, '') || {QUESTION} AS prompt FROM te LEFT JOIN ex ON ex.q = te.verse_id"),
    "zero_shot_prompts": with_(P, f"SELECT verse_id, {text(INTRO)} || {QUESTION} AS prompt FROM p"),
    "sft_prompt": with_(P, f"SELECT verse_id, {SFT_TEXT} AS prompt FROM p"),
    "sft_conversation": with_(P, f"SELECT verse_id, 0 AS pos, 'user' AS role, {SFT_TEXT} AS content FROM p UNION ALL SELECT verse_id, 1, 'assistant', text_target FROM p"),
    "chat_render": with_(P, f"SELECT verse_id, {text('<|user|>' + chr(10))} || {SFT_TEXT} || {text(chr(10) + '<|assistant|>' + chr(10))} AS text FROM p"),
    "parse_json_translation": with_(
        f"{P}, j AS (SELECT verse_id, {ANSWER} AS a FROM p)",
        "SELECT verse_id, coalesce(CASE WHEN json_valid(a) AND regexp_matches(a, '^\\s*\\{[\\s\\S]*\\}\\s*$') THEN json_extract_string(a, '$.translation') END, '') AS translation FROM j",
    ),
    "strip_think": with_(
        f"{H}, k AS (SELECT verse_id, CASE conv_id % 3 WHEN 0 THEN prediction WHEN 1 THEN {text('<think>a</think>' + chr(10) + ' ')} || prediction ELSE 'x</think>y</think>' || prediction || {text(' ' + chr(10))} END AS a FROM h)",
        f"SELECT verse_id, {strip('string_split(a, $$</think>$$)[-1]')} AS answer FROM k",
    ),
    "strip_text": with_(H, "SELECT verse_id, " + strip("(" + text("\n  ") + " || prediction || " + text(" \t　\r\n") + ")") + " AS text FROM h"),
    "tokenize_ws": explode("doc_id", tokens("text"), "documents"),
    "tokenize_tfidf": explode("doc_id", words("text"), "documents"),
    "word_ngrams": with_(P, gram_counts(4, f"SELECT {tokens_13a('text_target')} AS t FROM p", "array_to_string(t[i:i + n - 1], ' ')", "len(t)")),
    "char_ngrams": with_(P, gram_counts(6, f"SELECT regexp_replace(text_target, {text(SPACE)}, '', 'g') AS t FROM p", "substring(t, i, n)", "length(t)")),
    "mask_sentinel": with_(P, f"SELECT verse_id, array_to_string(list_transform({ID_LIST}, lambda x: CASE WHEN x = -100 THEN 1 ELSE x END), ',') AS ids FROM p"),
    "truncate_pad": with_(P, f"SELECT verse_id, array_to_string(list_resize({ID_LIST}, 24, 1), ',') AS ids FROM p"),
    "decode_tokens": with_(P, f"SELECT verse_id, array_to_string({tokens('text_source')}, ' ') AS text FROM p"),
    "corpus_bleu": with_(f"{H}, {metric(H_ROWS)}", "SELECT bleu FROM bleu"),
    "corpus_chrf": with_(f"{H}, {metric(H_ROWS)}", "SELECT chrf FROM chrf"),
    "eval_report": with_(f"{H}, {metric(H_ROWS)}", "SELECT verse_id, prediction, text_target AS target, bleu, chrf FROM h, bleu, chrf"),
    "metrics_json": with_(f"{H}, {metric(H_ROWS)}", "SELECT CAST(json_object('bleu', bleu, 'chrf', chrf) AS VARCHAR) AS report FROM bleu, chrf"),
    "sink_csv_roundtrip": with_(
        H,
        f"SELECT text_source, text_target, CASE conv_id % 5 WHEN 0 THEN {text(' ' + chr(34) + 'a' + chr(34) + ',' + chr(10))} || prediction WHEN 1 THEN '' WHEN 2 THEN prediction || '  ' WHEN 3 THEN prediction END AS prediction FROM h",
    ),
    "fewshot_end_to_end": with_(
        f"{SPLIT}, {metric(f'SELECT 1 AS grp, text_source AS prediction, text_target AS target FROM s WHERE split = {text("test")}')}",
        "SELECT (SELECT count(*) FROM rows_) AS n, bleu, chrf FROM bleu, chrf",
    ),
    "evaluate_by_book": with_(
        f"{H}, {metric(f'SELECT book AS grp, prediction, text_target AS target FROM h WHERE book NOT IN ({NT})')}",
        "SELECT bleu.grp AS book, bleu, chrf FROM bleu JOIN chrf USING (grp)",
    ),
}
