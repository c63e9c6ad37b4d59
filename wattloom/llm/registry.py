"""The operators as queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from wattloom.llm import chat, language, merkle, sharding, spelling, tokens, toxicity, urllists
from wattloom.llm.common import text_of
from wattloom.llm.decontam import SLOP, contamination
from wattloom.llm.exact_dedup import exact_duplicates
from wattloom.llm.line_dedup import drop_repeated_lines
from wattloom.llm.mixing import mix
from wattloom.llm.simhash import near_duplicates
from wattloom.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op10_exact_dedup",
    f"""WITH d AS (SELECT doc_id, {LOW} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
)
def op10(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op5_line_dedup",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
  unnest(string_split({LOW}, chr(10))) AS low, generate_subscripts(string_split({LOW}, chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, trim(low, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, s.key IS NOT NULL AND s.last <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
)
def op5(spark, sf_dir):
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op4_decontamination",
    rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex({LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 13) AS size FROM b WHERE len(w) > 0),
bw AS (SELECT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM n)),
dw AS (SELECT doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
    FROM d, (SELECT DISTINCT size FROM n) WHERE len(w) >= size)),
m AS (SELECT DISTINCT dw.doc_id, dw.size, dw.s, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id),
bi AS (SELECT item_id, size, unnest(w) AS term, unnest(range(len(w))) AS i FROM n),
di AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS p FROM d),
c AS (SELECT doc_id, item_id, size, s FROM (SELECT doc_id, item_id, size, i, unnest(range(p - i - 3, p - i + 4)) AS s FROM di JOIN bi USING (term))
  GROUP BY ALL HAVING count(DISTINCT i) >= ceil(round(size * 0.8, 9))),
cw AS (SELECT c.*, n.w AS x, list_slice(d.w, greatest(s - 3, 0) + 1, s + len(n.w) + 3) AS v, greatest(s - 3, 0) AS base
  FROM c JOIN n USING (item_id) JOIN d USING (doc_id)),
walk AS (SELECT doc_id, item_id, size, s, x, v, base, unnest(range(len(x) - size + 1)) AS start, 0 AS i, 0::BIGINT AS next, 0 AS k FROM cw
  UNION ALL SELECT doc_id, item_id, size, s, x, v, base, start, i + 1, CASE WHEN place > 0 THEN f + place ELSE next END, CASE WHEN place > 0 THEN k + 1 ELSE k END
  FROM (SELECT *, coalesce(list_position(list_slice(v, f + 1, s + start + i + 3 - base + 1), x[start + i + 1]), 0) AS place
    FROM (SELECT *, greatest(next, s + start + i - 3 - base, 0) AS f FROM walk WHERE i < size))),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM walk WHERE k >= ceil(round(size * 0.8, 9))) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated,
  coalesce(n_near, 0) AS n_near, sha256(coalesce(names, '')) AS near_sha256
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN near USING (doc_id)""",
)
def op4(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.drop("digest")


@query("op3_simhash")
def op3(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("digest")


@query("op6_mixing")
def op6(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def _escaped_length(column: str) -> str:
    for plain, coded in chat.ESCAPES:
        column = f"replace({column}, '{plain}', '{coded}')"
    return f"length({column})"


@query(
    "op9_chat_format",
    f"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
r AS (SELECT *, row_number() OVER w - 1 AS n, length(text) // 4 + 4 AS tokens FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
p AS (SELECT *, CAST((sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) - tokens) AS BIGINT) // {chat.BUDGET} AS raw,
  n = 0 AND role = 'system' AS head,
  {len(chat.TURN + chat.TEXT + chat.END) + 3} + length(CAST(n AS VARCHAR)) + {_escaped_length("role")} + {_escaped_length("text")}
    AS size FROM r),
v AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY raw) - 1 AS win FROM p),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id, win ORDER BY n DESC) AS from_end,
  max(win) OVER (PARTITION BY conv_id) AS last FROM v)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + coalesce(sum(size) FILTER (WHERE from_end <= {chat.HISTORY} AND tokens <= {chat.HISTORY_TOKENS}
      AND NOT head AND win < last), 0)
    + coalesce(sum(size * last) FILTER (WHERE head), 0) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
)
def op9(spark, sf_dir):
    """All conversations and one, -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    return scored.select(
        "doc_id",
        F.coalesce(toxicity.is_held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op1_language")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    learn = docs.filter(~F.coalesce(language.is_held_out(), F.lit(True)))
    model = language.fit(*language.fit_rows(learn))
    found = language.identify(docs, model)
    held_out = F.coalesce(language.is_held_out(), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op2_token_counts")
def op2(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokens.marked_automaton())


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, byte by byte; needs the table ``crc`` of CRC_TABLE."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))"
    step = "xor(c >> 8, steps[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


CRC_TABLE = """bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8)"""


@query(
    "op11_sharding",
    f"""WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32
  FROM documents, crc),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY md5(concat('{sharding.SEED}:', doc_id)), doc_id) - 0.5::DOUBLE)
  / count(*) OVER (PARTITION BY source) AS share FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY share, source NULLS LAST) - 1 AS place, count(*) OVER () AS total FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST((place * {sharding.SHARDS}) // total AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY (place * {sharding.SHARDS}) // total ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p""",
)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.octet_length(text_of("text")) + 8).cast("long").alias("size"),
        F.crc32(text_of("text")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(docs)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(
    "op12_spelling",
    f"""WITH RECURSIVE {CRC_TABLE},
o AS (SELECT doc_id, unnest(regexp_extract_all({LOW}, '[a-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM o GROUP BY doc_id, run),
h AS (SELECT run, n, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM u, crc WHERE doc_id IS NOT NULL
  UNION ALL SELECT run, n, 1 FROM u WHERE doc_id IS NULL),
c AS (SELECT CASE WHEN h % {spelling.DROP_EVERY} <> 0 THEN run
    ELSE concat(run[:CAST(h % length(run) AS BIGINT)], run[CAST(h % length(run) AS BIGINT) + 2:]) END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= {spelling.MIN_LENGTH}
  GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
k AS (SELECT word, n, i, concat(word[:i], word[i + 2:]) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
e AS (SELECT a.word, b.word AS other, b.n FROM k a JOIN k b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    AND length(a.word) = length(b.word)
  UNION SELECT a.word, b.word, b.n FROM k a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM k a JOIN w b ON a.rest = b.word),
g AS (SELECT word, count(*) AS n_near, min(struct_pack(o := -n, word := other)) AS best FROM e GROUP BY word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.o >= {spelling.RATIO} * n THEN best.word END AS form,
  CASE WHEN -best.o >= {spelling.RATIO} * n THEN -best.o END AS form_n FROM w LEFT JOIN g ON w.word = g.word),
x AS (SELECT word, word AS at_word, form AS next FROM f
  UNION ALL SELECT x.word, f.word, f.form FROM x JOIN f ON x.next = f.word)
SELECT f.word, form, x.at_word AS root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN x ON f.word = x.word AND x.next IS NULL""",
)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return spelling.spelling_variants(spelling.word_counts(docs, drop_every=spelling.DROP_EVERY))


def _field(value: str) -> str:
    return f"coalesce(concat(octet_length(encode(CAST({value} AS VARCHAR))), ':', {value}), '-')"


def _leaf(text: str) -> str:
    return f"sha256(concat({', '.join(_field(text if c == 'text' else c) for c in merkle.FIELDS)}))"


def _tree_sql(name: str, key: str, levels: int) -> str:
    """Levels ``<name>1``, ... over ``<name>0(key, i, d)``; ``<name>l_p(key, i, ds)`` has the children below each."""
    parts = []
    for k in range(levels):
        parts.append(
            f"""{name}{k}_p AS (SELECT {key}, i // 8 AS i, list(d ORDER BY i) AS ds FROM {name}{k} WHERE {key} IN
  (SELECT {key} FROM {name}{k} GROUP BY {key} HAVING count(*) > 1) GROUP BY {key}, i // 8),
{name}{k + 1} AS (SELECT {key}, i, sha256(array_to_string(ds, '')) AS d FROM {name}{k}_p
  UNION ALL SELECT {key}, i, d FROM {name}{k} WHERE {key} NOT IN (SELECT {key} FROM {name}{k}_p))"""
        )
    return ",\n".join(parts)


def _fold_sql(name: str, place: str, key: str, levels: int, start: str, out: str) -> str:
    """Step by step from ``start(id columns, now, proof)`` to ``out<levels>``: the replaced digest and the siblings passed."""
    parts = []
    for k in range(levels):
        slot = f"CAST((f.{place} // {8**k}) % 8 AS BIGINT)"
        left, right = f"array_to_string(ds[:{slot}], '')", f"array_to_string(ds[{slot} + 2:], '')"
        left = f"CASE WHEN {slot} = 0 THEN '' ELSE {left} END"
        parts.append(
            f"""{out}{k + 1} AS (SELECT f.* EXCLUDE (now, proof),
  CASE WHEN ds IS NULL THEN now ELSE sha256(concat({left}, now, {right})) END AS now,
  CASE WHEN ds IS NULL THEN proof ELSE concat(proof, {left}, {right}) END AS proof
  FROM {start if not k else out + str(k)} f LEFT JOIN {name}{k}_p q ON q.{key} = f.{key} AND q.i = f.{place} // {8 ** (k + 1)})"""
        )
    return ",\n".join(parts)


#: Levels that the SQL knows: two million rows of a language, 512 languages.
_DEEP, _WIDE = 7, 3


@query(
    "op13_merkle",
    f"""WITH RECURSIVE {CRC_TABLE},
h AS (SELECT *, doc_id IS NOT NULL AND {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS hit FROM documents, crc),
l AS (SELECT doc_id, {_leaf("text")} AS leaf, {_leaf("low")} AS changed, 0 AS one, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf("text")}) - 1 AS i
  FROM (SELECT *, CASE WHEN hit AND text IS NOT NULL THEN {LOW} ELSE text END AS low FROM h)),
n0 AS (SELECT t, i, leaf AS d FROM l),
{_tree_sql("n", "t", _DEEP)},
m0 AS (SELECT 0 AS one, t AS i, d FROM n{_DEEP}),
{_tree_sql("m", "one", _WIDE)},
s AS (SELECT *, changed AS now, '' AS proof FROM l),
{_fold_sql("n", "i", "t", _DEEP, "s", "f")},
{_fold_sql("m", "t", "one", _WIDE, f"f{_DEEP}", "g")}
SELECT doc_id, leaf, n{_DEEP}.d AS subroot, m{_WIDE}.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = m{_WIDE}.d AS verified
FROM g{_WIDE} f JOIN n{_DEEP} ON n{_DEEP}.t = f.t JOIN m{_WIDE} ON m{_WIDE}.one = f.one""",
)
def op13(spark, sf_dir):
    return merkle.verify_documents(table(spark, sf_dir, "documents"))


_START = 1_704_067_200  # 2024-01-01
_YEAR = 365 * 86_400
_FETCHED = f"CAST({_START} + (page_id * 7919) % {_YEAR} AS BIGINT)"
_BYTE = (
    "CAST((instr('0123456789abcdef', substr(md5(pattern), {0}, 1)) - 1) * 16"
    " + instr('0123456789abcdef', substr(md5(pattern), {1}, 1)) - 1 AS BIGINT)"
)
_B1, _B2, _B3 = (_BYTE.format(i, i + 1) for i in (1, 3, 5))
_DAY = f"{_START} + 86400 *"
# Dated entries made from the hosts, domains and first path parts of the pages themselves: (list, allow, which, when, added).
_ENTRIES = [
    ("spam", False, f"NOT has_path AND {_B1} < 128", f"{_DAY} {_B2}", True),
    ("spam", False, f"NOT has_path AND {_B1} < 96", f"{_DAY} ({_B2} + 20 + {_B3} % 64)", False),
    ("spam", False, f"NOT has_path AND {_B1} < 48", f"{_DAY} ({_B2} + 90 + {_B3} % 32)", True),
    ("adult", False, f"NOT has_path AND {_B1} >= 208", f"{_DAY} ({_B3} % 200)", True),
    ("trusted", True, f"has_path AND {_B1} < 96", f"{_DAY} {_B3}", True),
    ("trusted", True, f"has_path AND {_B1} < 32", f"{_DAY} ({_B3} + 30)", False),
]
_HOST = r"lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)"


@query(
    "op7_url_lists",
    f"""WITH p AS (SELECT page_id, url, {_FETCHED} AS fetched, {_HOST} AS host,
  list_filter(string_split({_PATH}, '/'), lambda x: x <> '') AS parts FROM pages),
k AS (SELECT page_id, fetched, unnest(list_concat(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, 99), '.')),
    list_transform(range(1, len(parts) + 1), lambda i: concat(host, '/', array_to_string(list_slice(parts, 1, i), '/')))))
  AS pattern FROM p WHERE host <> ''),
s AS (SELECT DISTINCT host AS pattern, false AS has_path FROM p WHERE host <> ''
  UNION SELECT DISTINCT regexp_replace(host, '^[^.]*[.]', ''), false FROM p WHERE host <> ''
  UNION SELECT DISTINCT lower(concat(host, '/', parts[1])), true FROM p WHERE host <> '' AND len(parts) > 0),
e AS ({" UNION ALL ".join(
    f"SELECT '{name}' AS list_name, {allow} AS allow, pattern, {at} AS since, {added} AS added FROM s WHERE {which}"
    for name, allow, which, at, added in _ENTRIES)}),
i AS (SELECT * FROM (SELECT list_name, allow, pattern, since AS start, added,
    lead(since) OVER (PARTITION BY list_name, allow, pattern ORDER BY since) AS stop
  FROM (SELECT list_name, allow, pattern, since, bool_and(added) AS added FROM e
    GROUP BY list_name, allow, pattern, since)) WHERE added),
m AS (SELECT k.page_id, i.* FROM k JOIN i ON k.pattern = i.pattern AND start <= fetched AND (stop IS NULL OR fetched < stop)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(i.pattern) DESC, NOT allow, list_name, i.pattern) = 1)
SELECT p.page_id, fetched, host, coalesce(NOT allow, false) AS blocked, list_name, pattern
FROM p LEFT JOIN m USING (page_id)""",
)
def op7(spark, sf_dir):
    """Pages carry no dates and no lists come with them, so both are derived from the pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_FETCHED).alias("fetched"))
    every = pages.select(
        urllists.host_of(F.col("url")).alias("host"),
        F.array_remove(F.split(F.expr(_PATH), "/"), "").alias("parts"),
    ).filter("host <> ''")
    hosts = every.select(F.col("host").alias("pattern"), F.lit(False).alias("has_path"))
    parents = every.select(F.regexp_replace("host", "^[^.]*[.]", ""), F.lit(False))
    paths = every.filter("size(parts) > 0").select(F.lower(F.concat("host", F.lit("/"), F.col("parts")[0])), F.lit(True))
    subjects = hosts.union(parents).union(paths).distinct()
    entries = None
    for name, allow, which, at, added in _ENTRIES:
        part = subjects.filter(which).select(
            F.lit(name).alias("list_name"), F.lit(allow).alias("allow"), "pattern", F.expr(f"{at} AS at"), F.lit(added).alias("added")
        )
        entries = part if entries is None else entries.unionByName(part)
    return urllists.judge(pages, entries).drop("url")


@query("pipeline")
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir).drop("text")
