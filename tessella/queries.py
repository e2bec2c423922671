"""One query per operator over the test tables, and the DuckDB SQL with the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import attributes, flat, keyed, regex, sharded, suffix, workload
from tessella.sources import corpus, storage

SHARDS = 4
QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf, table="documents", key="doc_id", text="text") -> DataFrame:
    return corpus.from_table(_t(spark, sf, table), key, text)


def _kv(spark, sf) -> DataFrame:
    """Orders as pipe-delimited lines in four shards."""
    o = _t(spark, sf, "orders")
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")], F.lit(""))
    return corpus.records(o, "o_orderkey", line, F.col("o_orderkey") % SHARDS)


_LINE = "concat(o_orderkey, '|', o_custkey, '|', o_orderstatus, '|', o_orderpriority, '|')"
_KV = f"kv AS (SELECT o_orderkey % {SHARDS} AS shard_id, o_orderkey AS key, {_LINE} AS value, coalesce(sum(strlen({_LINE}) + 1) OVER (PARTITION BY o_orderkey % {SHARDS} ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS value_offset FROM orders)"


def _keys(spark, sf) -> DataFrame:
    """All keys, and absent ones."""
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key")).union(spark.range(-3, 0).select(F.col("id").alias("key")))


_KEYS = "k AS (SELECT o_orderkey AS key FROM orders UNION ALL SELECT unnest([-3, -2, -1]) AS key)"


def _attrs(spark, sf) -> DataFrame:
    p = _t(spark, sf, "part")
    line = F.concat_ws(",", F.concat(F.lit("name="), "p_name"), F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("type="), "p_type"), F.concat(F.lit("size="), F.col("p_size").cast("string")))
    return p.select(F.col("p_partkey").alias("key"), corpus.parse_attributes(line).alias("attrs"))


def _hits(p: str, table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Offsets by splitting; for patterns that don't overlap themselves."""
    m = len(p.encode())
    return f"SELECT {key} AS doc_id, sum(strlen(piece) + {m}) OVER (PARTITION BY {key} ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - {m} AS off, i, n FROM (SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM (SELECT {key}, string_split({text}, '{p}') AS p FROM {table}))"


def _overlapping(p: str, table: str, key: str, text: str) -> str:
    return f"SELECT doc_id, off::BIGINT AS off FROM (SELECT {key} AS doc_id, {text} AS t, unnest(range(0, strlen({text}))) AS off FROM {table}) WHERE substr(t, off::INT + 1, {len(p)}) = '{p}'"


# flat view


@query(f"SELECT doc_id, off FROM ({_hits('an')}) WHERE i < n")
def flat_search(spark, sf):
    return flat.search(_docs(spark, sf), "an")


@query(f"SELECT doc_id, off FROM ({_hits('è')}) WHERE i < n")
def flat_search_multibyte(spark, sf):
    return flat.search(_docs(spark, sf), "è")


@query(_overlapping("00", "customer", "c_custkey", "c_name"))
def flat_search_overlap(spark, sf):
    return flat.search(_docs(spark, sf, "customer", "c_custkey", "c_name"), "00")


@query("SELECT sum((strlen(text) - strlen(replace(text, 'tion', ''))) // 4)::BIGINT AS n FROM documents")
def flat_count(spark, sf):
    return flat.count(_docs(spark, sf), "tion")


@query(f"SELECT count(*) AS n FROM ({_overlapping('00', 'customer', 'c_custkey', 'c_name')})")
def flat_count_overlap(spark, sf):
    return flat.count(_docs(spark, sf, "customer", "c_custkey", "c_name"), "00")


@query("SELECT doc_id, ((strlen(text) - strlen(replace(text, 'an', ''))) // 2)::BIGINT AS n FROM documents")
def flat_count_by_doc(spark, sf):
    return flat.count_by_doc(_docs(spark, sf), "an")


@query("SELECT url_id AS doc_id, substr(url, 6, 9) AS data FROM (SELECT page_id AS url_id, url FROM pages)")
def flat_extract(spark, sf):
    return flat.extract(_docs(spark, sf, "pages", "page_id", "url"), 5, 9).select("doc_id", F.col("data").cast("string").alias("data"))


@query("SELECT c_custkey AS doc_id, substr(repeat(c_name || chr(1), 3), 11, 20) AS data FROM customer")
def flat_extract_cyclic(spark, sf):
    return flat.extract(_docs(spark, sf, "customer", "c_custkey", "c_name"), 10, 20, wrap=True).select("doc_id", F.col("data").cast("string").alias("data"))


# keyed lines


@query(f"WITH {_KV} SELECT * FROM kv")
def kv_lines(spark, sf):
    return _kv(spark, sf).select("shard_id", "key", F.col("value").cast("string").alias("value"), "value_offset")


@query("WITH b AS (SELECT item_id, string_split(replace(text, ' ', chr(10)) || chr(10), chr(10)) AS p FROM benchmark) SELECT item_id AS shard_id, i - 1 AS key, v AS value, coalesce(sum(strlen(v) + 1) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS value_offset FROM (SELECT item_id, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM b)")
def kv_split_lines(spark, sf):
    """Lines of a text that ends with a newline: one more empty record."""
    docs = _t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.translate("text", " ", "\n"), F.lit("\n")).cast("binary").alias("content"))
    return corpus.lines(docs).select("shard_id", "key", "value_offset", F.col("value").cast("string").alias("value"))


@query("SELECT doc_id AS key FROM documents WHERE contains(text, 'an')")
def kv_search(spark, sf):
    return keyed.search(corpus.records(_t(spark, sf, "documents"), "doc_id", "text", F.col("doc_id") % SHARDS), "an")


@query("SELECT count(*) AS n FROM documents WHERE contains(text, 'idiot')")
def kv_count(spark, sf):
    return keyed.count(corpus.records(_t(spark, sf, "documents"), "doc_id", "text", F.col("doc_id") % SHARDS), "idiot")


@query(f"WITH {_KV}, {_KEYS} SELECT key, coalesce(value, '') AS value FROM k LEFT JOIN kv USING (key)")
def kv_get(spark, sf):
    return keyed.get(_kv(spark, sf), _keys(spark, sf)).select("key", F.col("value").cast("string").alias("value"))


@query(f"WITH {_KV}, {_KEYS} SELECT key, coalesce(substr(value, 4, 100), '') AS data FROM k LEFT JOIN kv USING (key)")
def kv_access(spark, sf):
    return keyed.access(_kv(spark, sf), _keys(spark, sf), 3, 100).select("key", F.col("data").cast("string").alias("data"))


@query(f"WITH {_KV} SELECT shard_id, value_offset + unnest([x - 1 FOR x IN range(1, strlen(value)) IF substr(value, x::INT, 2) = '|O']) AS off FROM kv WHERE contains(value, '|O')")
def kv_flat_search(spark, sf):
    return keyed.flat_search(_kv(spark, sf), "|O")


@query(f"WITH {_KV} SELECT sum(len([x FOR x IN range(1, strlen(value)) IF substr(value, x::INT, 2) = '11']))::BIGINT AS n FROM kv")
def kv_flat_count(spark, sf):
    return keyed.flat_count(_kv(spark, sf), "11")


@query(f"WITH {_KV}, s AS (SELECT string_agg(value, chr(10) ORDER BY key) AS t FROM kv WHERE shard_id = 1) SELECT substr(t, 1001, 500) AS data FROM s")
def kv_flat_extract(spark, sf):
    return keyed.flat_extract(_kv(spark, sf), 1, 1000, 500).select(F.col("data").cast("string").alias("data"))


@query(f"WITH {_KV} SELECT a.key FROM kv a JOIN kv b ON b.shard_id = a.shard_id AND b.key = (SELECT min(c.key) FROM kv c WHERE c.shard_id = a.shard_id AND c.key > a.key) WHERE suffix(a.value, '-URGENT|') AND prefix(b.value, '1')")
def kv_search_across_lines(spark, sf):
    return keyed.search(_kv(spark, sf), "-URGENT|\n1")


@query(f"WITH {_KV} SELECT shard_id, value_offset + 4 AS off, key FROM kv UNION ALL SELECT shard_id, 1000000000000 + max(key), max(key) FROM kv GROUP BY 1")
def kv_key_of_offset(spark, sf):
    """Every record's fifth byte, and offsets past the shards' ends."""
    kv = _kv(spark, sf)
    past = kv.groupBy("shard_id").agg((F.max("key") + 1_000_000_000_000).alias("off"))
    return keyed.key_of_offset(kv, kv.select("shard_id", (F.col("value_offset") + 4).alias("off")).union(past))


@query(f"WITH {_KV}, {_KEYS} SELECT key, coalesce(value_offset, -1)::BIGINT AS value_offset FROM k LEFT JOIN kv USING (key)")
def kv_position_of_key(spark, sf):
    return keyed.position_of_key(_kv(spark, sf), _keys(spark, sf))


@query(f"WITH {_KV} SELECT shard_id, value_offset + o AS off, 8::BIGINT AS len FROM (SELECT shard_id, value_offset, value, unnest([x - 1 FOR x IN range(1, strlen(value)) IF substr(value, x::INT, 2) = '1-']) AS o FROM kv) WHERE regexp_full_match(substr(value, o::INT + 1, 8), '1-[A-Z]{{6}}')")
def kv_regex_search(spark, sf):
    return keyed.regex_search(_kv(spark, sf), "1-([A-Z]){6,6}")


@query(f"WITH {_KV} SELECT DISTINCT shard_id, key FROM kv WHERE regexp_matches(value, '[|]F[|][1-3]-(URG|HIGH)')")
def kv_regex_keys(spark, sf):
    return keyed.regex_keys(_kv(spark, sf), "\\|F\\|[1-3]-(URG|HIGH)")


@query(f"WITH {_KV} SELECT 0 AS sub_id, count(*) AS n FROM kv WHERE contains(value, '|O|1-URGENT|') UNION ALL SELECT 1, sum(len(regexp_extract_all(value, '[0-9][|][FOP][|]')))::BIGINT FROM kv")
def kv_regex_count(spark, sf):
    """Counts of both sides of a gap."""
    return keyed.regex_count(_kv(spark, sf), "\\|O\\|1-URGENT\\|.*[0-9]\\|[FOP]\\|")


def _starts(p: str) -> str:
    return f"SELECT shard_id, value_offset + unnest([x - 1 FOR x IN range(1, strlen(value)) IF substr(value, x::INT, {len(p)}) = '{p}']) AS off FROM kv"


@query(f"WITH {_KV}, a AS ({_starts('999|')}), b AS ({_starts('|F|2-HIGH|')}) SELECT a.shard_id, a.off, b.off + 10 - a.off AS len FROM a JOIN b ON a.shard_id = b.shard_id AND b.off >= a.off + 4")
def kv_regex_gap(spark, sf):
    """Pairs over a gap that crosses records."""
    return keyed.regex_search(_kv(spark, sf), "999\\|.*\\|F\\|2-HIGH\\|")


@query("SELECT count(*) AS n FROM orders")
def kv_num_keys(spark, sf):
    return keyed.num_keys(_kv(spark, sf))


@query("SELECT o_orderkey AS key FROM orders WHERE o_custkey = 7 OR o_orderstatus = '7' OR o_orderpriority = '7'")
def kv_field_search(spark, sf):
    return keyed.search_field(_kv(spark, sf), "7")


# attribute records


@query("SELECT p_partkey AS key FROM part WHERE p_size = 7")
def attr_search(spark, sf):
    return attributes.search(_attrs(spark, sf), "size", "7")


@query("SELECT count(*) AS n FROM part WHERE p_brand = 'Brand#12'")
def attr_count(spark, sf):
    return attributes.count(_attrs(spark, sf), "brand", "Brand#12")


@query("SELECT p_partkey AS key, concat('name=', p_name, ',brand=', p_brand, ',type=', p_type, ',size=', p_size) AS record FROM part")
def attr_get(spark, sf):
    return attributes.get(_attrs(spark, sf))


@query("SELECT p_partkey AS key, p_type AS value FROM part")
def attr_get_attribute(spark, sf):
    return attributes.get_attribute(_attrs(spark, sf), "type")


_RECORD = "concat('name=', p_name, ',brand=', p_brand, ',type=', p_type, ',size=', p_size)"


@query(f"SELECT p_partkey AS key FROM part WHERE contains({_RECORD}, 'Brand#12,type=')")
def attr_text_search(spark, sf):
    """The records' text by the verbs of keyed lines."""
    return keyed.search(attributes.rendered(_attrs(spark, sf)), "Brand#12,type=")


@query(f"SELECT p_partkey AS key FROM part WHERE regexp_matches({_RECORD}, 'Brand#[1-3]4,type=[A-Z]')")
def attr_regex_keys(spark, sf):
    return keyed.regex_keys(attributes.rendered(_attrs(spark, sf)), "Brand#[1-3]4,type=[A-Z]").select("key")


# regular expressions


def _all_matches(emitted: str, table: str = "customer", key: str = "c_custkey", text: str = "c_name") -> str:
    return f"SELECT doc_id, off::BIGINT AS off, len::BIGINT AS len FROM (SELECT doc_id, t, off, unnest(range(1, strlen(t) - off + 1)) AS len FROM (SELECT {key} AS doc_id, {text} AS t, unnest(range(0, strlen({text}))) AS off FROM {table})) WHERE regexp_full_match(substr(t, off::INT + 1, len::INT), '{emitted}')"


def _names(spark, sf):
    return _docs(spark, sf, "customer", "c_custkey", "c_name")


@query(_all_matches("[0-9]+"))
def regex_class_run(spark, sf):
    return regex.search(_names(spark, sf), "[0-9]+")


@query(_all_matches("#0+[1-3]"))
def regex_concat(spark, sf):
    return regex.search(_names(spark, sf), "#(0)+([1-3])")


@query(_all_matches("(er|om)"))
def regex_union(spark, sf):
    return regex.search(_names(spark, sf), "er|om")


@query(_all_matches("0{2,4}"))
def regex_bounded(spark, sf):
    return regex.search(_names(spark, sf), "(0){2,4}")


@query(_all_matches("(mer#)+[^\\n\\x01]"))
def regex_run_precedence(spark, sf):
    return regex.search(_names(spark, sf), "mer#+(.)")


@query(_all_matches("m(e|r)*#"))
def regex_star(spark, sf):
    return regex.search(_names(spark, sf), "m(e|r)*#")


_PAIRS = f"WITH a AS ({_all_matches('er')}), b AS ({_all_matches('0+')}) SELECT DISTINCT a.doc_id, a.off, b.off + b.len - a.off AS len FROM a JOIN b ON a.doc_id = b.doc_id AND b.off >= a.off + a.len"


@query(_PAIRS)
def regex_gap(spark, sf):
    return regex.search(_names(spark, sf), "er.*(0)+")


@query(f"SELECT 0 AS sub_id, count(*) AS n FROM ({_all_matches('er')}) UNION ALL SELECT 1, count(*) FROM ({_all_matches('0+')})")
def regex_count(spark, sf):
    return regex.count(_names(spark, sf), "er.*(0)+")


@query(_all_matches("r#0*"))
def regex_star_last_forwards(spark, sf):
    """The last star may be skipped: the pattern starts with a literal and doesn't end with one."""
    return regex.search(_names(spark, sf), "r#([0])*")


@query(_all_matches("r#0+"))
def regex_star_last_backwards(spark, sf):
    """The last star is evaluated first and needs one."""
    return regex.search(_names(spark, sf), "r#(0)*")


@query(_all_matches("0*1"))
def regex_star_first_backwards(spark, sf):
    return regex.search(_names(spark, sf), "(0)*1")


@query(_all_matches("0+[1-3]"))
def regex_star_first_forwards(spark, sf):
    return regex.search(_names(spark, sf), "(0)*[1-3]")


@query(_all_matches("r#0*"))
def regex_star_standard(spark, sf):
    """In standard mode every star may be skipped."""
    return regex.search(_names(spark, sf), "r#(0)*", mode="standard")


@query(_all_matches("#0{1,2}"))
def regex_zero_to_two(spark, sf):
    """{0,n} needs one."""
    return regex.search(_names(spark, sf), "#(0){0,2}")


@query(_all_matches("#0{0,2}"))
def regex_zero_to_two_standard(spark, sf):
    return regex.search(_names(spark, sf), "#(0){0,2}", mode="standard")


@query("SELECT o_orderkey AS doc_id, unnest([x - 1 FOR x IN range(1, strlen(t)) IF substr(t, x::INT, 5) = '|{F}*'])::BIGINT AS off, 5::BIGINT AS len FROM (SELECT o_orderkey, concat('(', o_orderkey, '|{', o_orderstatus, '}*', o_orderpriority, ')') AS t FROM orders)")
def regex_escape(spark, sf):
    """Escaped signs are literals."""
    t = F.concat(F.lit("("), F.col("o_orderkey").cast("string"), F.lit("|{"), "o_orderstatus", F.lit("}*"), "o_orderpriority", F.lit(")"))
    return regex.search(corpus.from_table(_t(spark, sf, "orders").withColumn("t", t), "o_orderkey", "t"), "\\|\\{F\\}\\*")


@query(f"WITH a AS (SELECT doc_id, off FROM ({_hits('idiot')}) WHERE i < n), b AS (SELECT doc_id, off FROM ({_hits('stupid')}) WHERE i < n) SELECT DISTINCT a.doc_id, a.off, b.off + 6 - a.off AS len FROM a JOIN b ON a.doc_id = b.doc_id AND b.off >= a.off + 5")
def regex_gap_documents(spark, sf):
    """Whole texts."""
    return regex.search(_docs(spark, sf), "idiot.*stupid")


@query("SELECT 0 AS sub_id, sum((strlen(text) - strlen(replace(text, 'an', ''))) // 2)::BIGINT AS n FROM documents UNION ALL SELECT 1, sum((strlen(text) - strlen(replace(text, 'tion', ''))) // 4)::BIGINT FROM documents")
def regex_count_documents(spark, sf):
    """Whole texts, in one pass without Python workers."""
    return regex.count(_docs(spark, sf), "an.*tion")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, off, {len(p)}::BIGINT AS len FROM ({_hits(p)}) WHERE i < n" for p in ("worthless", "pathetic", "disgusting")) + ")")
def regex_documents(spark, sf):
    """Whole texts."""
    return regex.search(_docs(spark, sf), "worthless|pathetic|disgusting")


@query(f"SELECT * FROM ({_all_matches('[0-9]+')}) ORDER BY doc_id, off, len LIMIT 10")
def regex_show(spark, sf):
    return regex.show(_names(spark, sf), "[0-9]+")


# shards


def _flat_shards(spark, sf) -> DataFrame:
    return _docs(spark, sf, "benchmark", "item_id", "text")


_BASES = "b AS (SELECT item_id AS doc_id, text, strlen(text) + 1 AS size, coalesce(sum(strlen(text) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM benchmark)"


@query("SELECT sum((strlen(text) - strlen(replace(text, 'an', ''))) // 2)::BIGINT AS n FROM benchmark")
def shard_count(spark, sf):
    return sharded.count(_flat_shards(spark, sf), "an")


@query(f"WITH {_BASES} SELECT doc_id, h.off + base AS off FROM ({_hits('an', 'benchmark', 'item_id')}) h JOIN b USING (doc_id) WHERE i < n")
def shard_search(spark, sf):
    return sharded.search(_flat_shards(spark, sf), "an")


@query(f"WITH {_BASES} SELECT doc_id, decode(array_slice(encode(text), (3000 - base + 1)::BIGINT, (3000 - base + 40)::BIGINT)) AS data FROM b WHERE base <= 3000 AND 3000 < base + size")
def shard_extract(spark, sf):
    return sharded.extract(_flat_shards(spark, sf), 3000, 40).select("doc_id", F.col("data").cast("string").alias("data"))


@query(f"WITH {_BASES} SELECT doc_id, base, size FROM b")
def shard_bases(spark, sf):
    return sharded.bases(_flat_shards(spark, sf))


@query("SELECT count(*) AS n_shards, sum(strlen(text) + 1)::BIGINT AS total_size FROM benchmark")
def shard_sizes(spark, sf):
    return sharded.sizes(_flat_shards(spark, sf))


@query(f"WITH {_BASES} SELECT doc_id, h.off + base AS off, len FROM (SELECT doc_id, off, 2::BIGINT AS len FROM ({_hits('er', 'benchmark', 'item_id')}) WHERE i < n UNION ALL SELECT doc_id, off, 4 FROM ({_hits('tion', 'benchmark', 'item_id')}) WHERE i < n) h JOIN b USING (doc_id)")
def shard_regex(spark, sf):
    return sharded.regex(_flat_shards(spark, sf), "er|tion")


@query("SELECT item_id AS doc_id, off::BIGINT AS off, 3::BIGINT AS len FROM (SELECT item_id, encode(text) AS t, unnest(range(0, strlen(text))) AS off FROM benchmark) WHERE array_slice(t, off + 1, off + 3) IN ('tha'::BLOB, 'the'::BLOB)")
def shard_regex_local(spark, sf):
    """By the shards' own offsets."""
    return sharded.regex(_flat_shards(spark, sf), "th[ae]", local=True)


@query(f"WITH {_KV} SELECT shard_id, value_offset + strlen(value) - 8 AS off, 10::BIGINT AS len FROM (SELECT *, lead(value) OVER (PARTITION BY shard_id ORDER BY key) AS after FROM kv) WHERE suffix(value, '-URGENT|') AND prefix(after, '1')")
def shard_kv_regex(spark, sf):
    """A match that goes on in the next record."""
    return sharded.keyed_regex(_kv(spark, sf), "-URGENT\\|\n1")


@query(f"WITH {_KV} SELECT shard_id * 4294967296 + key AS key FROM kv WHERE regexp_matches(value, '[|][FO][|]5')")
def shard_kv_regex_keys(spark, sf):
    return sharded.keyed_regex_keys(_kv(spark, sf), "\\|[FO]\\|5")


_NEXT = "(SELECT *, lead(value) OVER (PARTITION BY shard_id ORDER BY key) AS after FROM kv)"


@query(f"WITH {_KV} SELECT shard_id * 4294967296 + key AS key FROM {_NEXT} WHERE suffix(value, '-URGENT|') AND prefix(after, '1')")
def shard_kv_search_across_lines(spark, sf):
    return sharded.keyed_search(_kv(spark, sf), "-URGENT|\n1")


@query(f"WITH {_KV} SELECT shard_id, count(*) FILTER (suffix(value, '-URGENT|') AND prefix(after, '1')) AS n FROM {_NEXT} GROUP BY 1")
def shard_kv_count_across_lines(spark, sf):
    return sharded.keyed_count(_kv(spark, sf), "-URGENT|\n1")


@query(f"WITH {_KV} SELECT shard_id * 4294967296 + key AS key, value FROM kv UNION ALL SELECT 99 * 4294967296, ''")
def shard_kv_get(spark, sf):
    kv = _kv(spark, sf)
    keys = kv.select(sharded.pack(F.col("shard_id"), F.col("key")).alias("key")).union(spark.range(1).select(sharded.pack(F.lit(99), F.lit(0)).alias("key")))
    return sharded.keyed_get(kv, keys).select("key", F.col("value").cast("string").alias("value"))


@query(f"WITH {_KV} SELECT shard_id * 4294967296 + key AS key FROM kv WHERE contains(value, 'URGENT')")
def shard_kv_search(spark, sf):
    return sharded.keyed_search(_kv(spark, sf), "URGENT")


@query(f"WITH {_KV} SELECT shard_id, count(*) FILTER (contains(value, 'URGENT')) AS n FROM kv GROUP BY 1")
def shard_kv_count(spark, sf):
    return sharded.keyed_count(_kv(spark, sf), "URGENT")


@query(f"WITH {_KV}, k AS (SELECT o_orderkey % {SHARDS} * 4294967296 + o_orderkey AS key FROM orders UNION ALL SELECT 99 * 4294967296) SELECT k.key, coalesce(substr(value, 2, 6), '') AS data FROM k LEFT JOIN kv ON kv.shard_id * 4294967296 + kv.key = k.key")
def shard_kv_access(spark, sf):
    o = F.col("o_orderkey")
    keys = _t(spark, sf, "orders").select(sharded.pack(o % SHARDS, o).alias("key")).union(spark.range(1).select(sharded.pack(F.lit(99), F.lit(0)).alias("key")))
    return sharded.keyed_access(_kv(spark, sf), keys, 1, 6).select("key", F.col("data").cast("string").alias("data"))


@query(f"WITH {_KV} SELECT shard_id, count(*) AS n FROM kv GROUP BY 1")
def shard_num_keys(spark, sf):
    return sharded.num_keys(_kv(spark, sf))


@query("SELECT 0::BIGINT AS n")
def shard_num_keys_absent(spark, sf):
    return sharded.num_keys_of(_kv(spark, sf), 77)


# suffix order: of each benchmark item, and of all items as one text


def _items(spark, sf) -> DataFrame:
    return _docs(spark, sf, "benchmark", "item_id", "text")


def _one_text(spark, sf) -> DataFrame:
    """All items as one text, longer than what is sorted directly."""
    one = _t(spark, sf, "benchmark").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return one.select(F.lit(0).cast("long").alias("doc_id"), F.col("t").cast("binary").alias("content"))


def _suffixes(texts: str) -> str:
    """t: texts with their sentinel; sa: their suffix arrays."""
    return f"t AS ({texts}), s AS (SELECT doc_id, t, unnest(range(0, octet_length(t))) AS sa FROM t), sa AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY array_slice(t, sa + 1, octet_length(t))) - 1 AS idx, sa FROM s)"


_SA = _suffixes("SELECT item_id AS doc_id, encode(text || chr(1)) AS t FROM benchmark")
_BYTE = "hex(array_slice(t, sa + 1, sa + 1))"


@query(f"WITH {_SA} SELECT doc_id, idx, sa FROM sa")
def suffix_array(spark, sf):
    return suffix.suffix_array(_items(spark, sf))


@query(f"WITH {_suffixes("SELECT 0::BIGINT AS doc_id, encode(string_agg(text, chr(10) ORDER BY item_id) || chr(1)) AS t FROM benchmark")} SELECT doc_id, idx, sa FROM sa")
def suffix_array_long(spark, sf):
    """By prefix doubling."""
    return suffix.suffix_array(_one_text(spark, sf))


@query(f"WITH {_SA} SELECT doc_id, sa AS pos, idx AS isa FROM sa")
def suffix_inverse(spark, sf):
    return suffix.inverse(suffix.suffix_array(_items(spark, sf)))


@query(f"WITH {_SA}, n AS (SELECT doc_id, count(*) AS n FROM sa GROUP BY 1) SELECT doc_id, a.idx, b.idx AS npa FROM sa a JOIN n USING (doc_id) JOIN sa b USING (doc_id) WHERE b.sa = (a.sa + 1) % n")
def suffix_next(spark, sf):
    return suffix.next_pointers(suffix.suffix_array(_items(spark, sf)))


@query(f"WITH {_SA}, c AS (SELECT doc_id, {_BYTE} AS byte, count(*) AS n FROM s GROUP BY ALL) SELECT doc_id, row_number() OVER w - 1 AS char_id, byte, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_row FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY byte)")
def suffix_alphabet(spark, sf):
    return suffix.alphabet(_items(spark, sf)).withColumn("byte", F.hex("byte"))


@query(f"WITH {_SA} SELECT doc_id, idx, dense_rank() OVER (PARTITION BY doc_id ORDER BY {_BYTE}) - 1 AS char_id FROM sa JOIN t USING (doc_id)")
def suffix_char_ids(spark, sf):
    docs = _items(spark, sf)
    return suffix.char_ids(docs, suffix.suffix_array(docs))


def _range(pattern: str) -> str:
    starts = f"array_slice(t, sa + 1, sa + {len(pattern)}) = '{pattern}'::BLOB"
    return f"WITH {_SA} SELECT doc_id, coalesce(min(idx) FILTER ({starts}), 0)::BIGINT AS first, coalesce(max(idx) FILTER ({starts}), -1)::BIGINT AS last FROM sa JOIN t USING (doc_id) GROUP BY 1"


@query(_range("er"))
def suffix_pattern_range(spark, sf):
    docs = _items(spark, sf)
    return suffix.pattern_range(docs, suffix.suffix_array(docs), "er")


@query(_range("ther"))
def suffix_continue_backward(spark, sf):
    docs = _items(spark, sf)
    sa = suffix.suffix_array(docs)
    return suffix.continue_backward(docs, sa, suffix.pattern_range(docs, sa, "er"), "th")


@query(_range("ther"))
def suffix_continue_forward(spark, sf):
    docs = _items(spark, sf)
    sa = suffix.suffix_array(docs)
    return suffix.continue_forward(docs, sa, suffix.pattern_range(docs, sa, "th"), 2, "er")


@query("SELECT item_id AS doc_id, hex(array_slice(encode(text), 4, 4)) AS byte FROM benchmark")
def suffix_char_at(spark, sf):
    return suffix.char_at(_items(spark, sf), 3).withColumn("byte", F.hex("byte"))


# sizes and workloads


@query("SELECT doc_id, strlen(text)::BIGINT + 1 AS size FROM documents")
def original_size(spark, sf):
    return storage.original_size(_docs(spark, sf))


def _saved(spark: SparkSession, **components: DataFrame) -> str:
    path = f"{storage.shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    storage.save(path, **components)
    return path


@query(f"WITH {_KV} SELECT * FROM kv")
def storage_load(spark, sf):
    """Records saved and read back lazily."""
    path = _saved(spark, records=_kv(spark, sf))
    return storage.load(spark, path, "records").select("shard_id", "key", F.col("value").cast("string").alias("value"), "value_offset")


@query(f"WITH {_KV} SELECT key, value, value_offset FROM kv WHERE shard_id = 1")
def storage_load_shard(spark, sf):
    """One shard of saved records: only its folder is read."""
    path = _saved(spark, records=_kv(spark, sf))
    return storage.load(spark, path, "records").where("shard_id = 1").select("key", F.col("value").cast("string").alias("value"), "value_offset")


@query("SELECT doc_id, text, strlen(text)::BIGINT AS n_bytes FROM documents")
def storage_load_in_memory(spark, sf):
    """Texts saved and read back cached."""
    path = _saved(spark, texts=_docs(spark, sf))
    return storage.load(spark, path, "texts", in_memory=True).select("doc_id", F.col("content").cast("string").alias("text"), F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT p_partkey AS key FROM part WHERE p_size = 7")
def storage_load_attributes(spark, sf):
    """Attribute records saved, read back and searched."""
    path = _saved(spark, attrs=_attrs(spark, sf))
    return attributes.search(storage.load(spark, path, "attrs"), "size", "7")


@query("SELECT unnest(['attrs', 'metadata', 'records']) AS component, true AS has_bytes, true AS adds_up")
def storage_breakdown(spark, sf):
    """Bytes by component; they add up to the whole."""
    path = _saved(spark, records=_kv(spark, sf), attrs=_attrs(spark, sf))
    parts = storage.breakdown(spark, path)
    total = parts.agg(F.sum("bytes").alias("total"))
    return parts.crossJoin(F.broadcast(total)).select("component", (F.col("bytes") > 0).alias("has_bytes"), (F.col("total") == storage.total_size(spark, path)).alias("adds_up"))


@query("SELECT r_regionkey::BIGINT AS doc_id, r_name AS text FROM region")
def source_files(spark, sf):
    """Texts written as files and read as a corpus of files."""
    path = f"{storage.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    _t(spark, sf, "region").select("r_name", "r_regionkey").write.partitionBy("r_regionkey").text(path)
    files = corpus.read_files(spark, f"{path}/*/part-*")
    return files.select(F.regexp_extract("path", "r_regionkey=(\\d+)", 1).cast("long").alias("doc_id"), F.rtrim(F.col("content").cast("string"), F.lit("\n")).alias("text"))


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT), (0, 1), (0, 2), (2, 1)) x(doc_id, off)")
def source_buffers(spark, sf):
    """Buffers searched."""
    return flat.search(corpus.from_buffers(spark, [b"aaaa", b"", b"baa"]), "aa")


@query("SELECT key, v AS line, coalesce(a.v2, '') AS size FROM (SELECT p_partkey AS key, concat('a=', p_name, ',size=', p_size) AS v, p_size::VARCHAR AS v2 FROM part) a")
def attr_lines(spark, sf):
    """Attribute records from lines of one text per record."""
    text = F.concat(F.lit("a="), "p_name", F.lit(",size="), F.col("p_size").cast("string"), F.lit("\n")).cast("binary")
    rows = corpus.attribute_lines(_t(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("content")))
    one = rows.select(F.col("shard_id").alias("key"), "attrs")
    return attributes.get(one).withColumnRenamed("record", "line").join(attributes.get_attribute(one, "size").withColumnRenamed("value", "size"), "key")


_ZIPF = "n AS (SELECT count(*) AS n FROM orders), w AS (SELECT i - 1 AS k, sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT unnest(range(1, n + 1)) AS i FROM n)), d AS (SELECT ('0x' || substr(md5('42:' || id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 * (SELECT max(c) FROM w) AS u FROM range(2000) t(id)), z AS (SELECT (SELECT min(k) FROM w WHERE c > u) AS key FROM d)"


@query(f"WITH {_KV}, {_ZIPF} SELECT z.key, coalesce(value, '') AS value FROM z LEFT JOIN kv USING (key)")
def zipf_lookups(spark, sf):
    """Gets of keys drawn by a Zipf law over as many keys as there are orders."""
    kv = _kv(spark, sf)
    keys = workload.zipf_keys(spark, kv.count(), 2000)
    return keyed.get(kv, keys.select("key")).select("key", F.col("value").cast("string").alias("value"))
