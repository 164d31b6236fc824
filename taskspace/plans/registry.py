"""Registered queries over the given tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import ranges
from ..functions import paths
from ..operators import content, manifest, model, space
from ..operators.manifest import Manifest
from ..ranges import RangeExpr
from ..session import Tables, shared_dir
from ..sources import manifest_text
from ..streaming import chunks, directives
from . import compiler

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def expressions(name: str, source: str, keep: list[str], exprs: dict[str, str], sql: str | None = None, where: str | None = None):
    """A query that is a projection of compiled expressions over a table."""

    @query(name, sql)
    def run(spark, sf):
        df = table(spark, sf, source)
        return compiler.select(compiler.where(df, where) if where else df, exprs, keep)


# -- expressions ------------------------------------------------------------------------------------------------------
expressions(
    "expr_arith",
    "lineitem",
    ["l_orderkey", "l_linenumber"],
    {"a": "l_orderkey * 2 + l_linenumber // 2", "b": "l_quantity * 2 - 1.5", "c": "l_partkey - l_suppkey * 3", "d": "l_linenumber ** 3", "e": "-l_orderkey % 7", "f": "l_quantity // 4", "g": "+l_linenumber / 4"},
    "select l_orderkey, l_linenumber, l_orderkey * 2 + l_linenumber // 2 as a, l_quantity * 2 - 1.5 as b, l_partkey - l_suppkey * 3 as c, cast(l_linenumber as bigint) * l_linenumber * l_linenumber as d, ((-l_orderkey % 7) + 7) % 7 as e, cast(floor(l_quantity / 4) as bigint) as f, l_linenumber / 4 as g from lineitem",
)
expressions(
    "expr_floor_mod",
    "orders",
    ["o_orderkey"],
    {"q": "(o_orderkey - 700) // 7", "r": "(o_orderkey - 700) % 7", "qn": "(o_orderkey - 700) // -7", "rn": "(o_orderkey - 700) % -7"},
    "select o_orderkey, cast(floor((o_orderkey - 700) / 7.0) as bigint) as q, cast(o_orderkey - 700 - 7 * floor((o_orderkey - 700) / 7.0) as bigint) as r, cast(floor((o_orderkey - 700) / -7.0) as bigint) as qn, cast(o_orderkey - 700 + 7 * floor((o_orderkey - 700) / -7.0) as bigint) as rn from orders",
)
expressions("expr_compare_chain", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], {"mid": "1 < l_quantity <= 25", "not_r": "l_returnflag != 'R' and l_returnflag in ['A', 'N']", "out": "l_linenumber not in [1, 2, 3]"}, "select l_orderkey, l_linenumber, l_quantity, l_quantity > 1 and l_quantity <= 25 as mid, l_returnflag <> 'R' and l_returnflag in ('A', 'N') as not_r, l_linenumber not in (1, 2, 3) as out from lineitem where l_quantity > 10", where="l_quantity > 10")
expressions("expr_conditional", "customer", ["c_custkey"], {"tier": "'gold' if c_acctbal > 5000 else 'silver' if c_acctbal > 0.0 else 'none'", "safe": "100 // c_nationkey if c_nationkey != 0 else fail('no nation') if c_custkey < 0 else 0"}, "select c_custkey, case when c_acctbal > 5000 then 'gold' when c_acctbal > 0 then 'silver' else 'none' end as tier, case when c_nationkey <> 0 then cast(100 // c_nationkey as bigint) else 0 end as safe from customer")
expressions("expr_bool_operand", "events", ["event_id"], {"both": "value > 50.0 and event_type == 'click'", "either": "value > 50.0 or event_type == 'view'", "neither": "not (value > 50.0 or event_type == 'view')", "kept": "event_type or 'none'", "last": "event_type and user_id"}, "select event_id, value > 50 and event_type = 'click' as both, value > 50 or event_type = 'view' as either, not (value > 50 or event_type = 'view') as neither, event_type as kept, user_id as last from events")


@query("fmt_resolve", "select p_partkey, p_name || '-' || p_size || ' [' || upper(p_brand) || ']' as label, cast(p_size as bigint) as single, 'no parts' as plain from part")
def fmt_resolve(spark, sf):
    df = table(spark, sf, "part")
    c = compiler.Compiler(compiler.Symbols.of(df, "Param."))
    return df.select("p_partkey", compiler.resolve("{{Param.p_name}}-{{ Param.p_size }} [{{Param.p_brand.upper()}}]", c).col.alias("label"), compiler.resolve("{{Param.p_size}}", c).col.alias("single"), compiler.resolve("no parts", c).col.alias("plain"))


@query("let_bindings", "select p_partkey, cast(p_size as bigint) * 2 as twice, cast(p_size as bigint) * 2 + 1 as more, 'n' || (cast(p_size as bigint) * 2 + 1) as name from part")
def let_bindings(spark, sf):
    df = compiler.let(table(spark, sf, "part"), ["twice = p_size * 2", "more = twice + 1", "name = 'n' + string(more)"])
    return df.select("p_partkey", "twice", "more", "name")


# -- strings ----------------------------------------------------------------------------------------------------------
expressions("str_case_affix", "part", ["p_partkey"], {"up": "p_name.upper()", "low": "p_brand.lower()", "starts": "p_brand.startswith('Brand#1')", "ends": "p_type.endswith('STEEL')", "no_prefix": "p_brand.removeprefix('Brand#')", "no_suffix": "p_type.removesuffix('STEEL')", "swapped": "p_brand.replace('Brand', 'B')"}, "select p_partkey, upper(p_name) as up, lower(p_brand) as low, starts_with(p_brand, 'Brand#1') as starts, ends_with(p_type, 'STEEL') as ends, case when starts_with(p_brand, 'Brand#') then substr(p_brand, 7) else p_brand end as no_prefix, case when ends_with(p_type, 'STEEL') then left(p_type, length(p_type) - 5) else p_type end as no_suffix, replace(p_brand, 'Brand', 'B') as swapped from part")
expressions("str_find_count", "documents", ["doc_id"], {"at": "text.find('the ')", "last": "text.rfind('the ')", "n": "text.count('the ')", "size": "len(text)"}, "select doc_id, strpos(text, 'the ') - 1 as at, case when strpos(text, 'the ') = 0 then -1 else length(text) - 4 - strpos(reverse(text), ' eht') + 1 end as last, (length(text) - length(replace(text, 'the ', ''))) // 4 as n, length(text) as size from documents")
expressions("str_pad_zfill", "part", ["p_partkey"], {"left": "p_brand.ljust(12) + '|'", "right": "p_brand.rjust(12)", "mid": "p_brand.center(13)", "zeros": "zfill(p_size, 5)", "signed": "zfill(string(0 - p_size), 6)", "same": "p_type.ljust(2)"}, "select p_partkey, rpad(p_brand, 12, ' ') || '|' as left, lpad(p_brand, 12, ' ') as right, repeat(' ', (13 - length(p_brand)) // 2 + case when (13 - length(p_brand)) % 2 = 1 then 1 else 0 end) || p_brand || repeat(' ', (13 - length(p_brand)) // 2) as mid, lpad(cast(p_size as varchar), 5, '0') as zeros, '-' || lpad(cast(p_size as varchar), 5, '0') as signed, p_type as same from part")
expressions("str_split_join", "part", ["p_partkey"], {"words": "len(p_type.split())", "joined": "join(p_type.split(' '), '-')", "head": "p_type.split(' ', 1)[0]", "tail": "p_type.rsplit(' ', 1)[-1]", "back": "join(reversed(p_name.split()), ' ')"}, "select p_partkey, len(string_split(p_type, ' ')) as words, array_to_string(string_split(p_type, ' '), '-') as joined, string_split(p_type, ' ')[1] as head, string_split(p_type, ' ')[-1] as tail, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') as back from part")
expressions("str_predicates", "documents", ["doc_id"], {"digits": "string(doc_id).isdigit()", "alpha": "lang.isalpha()", "ascii": "isascii(text)", "space": "text.isspace()", "upper": "lang.upper().isupper()", "lower": "text.islower()"}, "select doc_id, regexp_full_match(cast(doc_id as varchar), '[0-9]+') as digits, regexp_full_match(lang, '\\pL+') as alpha, strlen(text) = length(text) as ascii, regexp_full_match(text, '\\s+') as space, upper(lang) = upper(lang) and regexp_matches(upper(lang), '\\p{Lu}') as upper, text = lower(text) and regexp_matches(text, '\\p{Ll}') as lower from documents")
expressions("str_strip", "part", ["p_partkey"], {"inner": "('  ' + p_brand + '\\t').strip()", "left": "('xx' + p_name).lstrip('x')", "right": "(p_name + 'yy').rstrip('y')"}, "select p_partkey, p_brand as inner, ltrim(p_name, 'x') as left, rtrim(p_name, 'y') as right from part")
expressions("str_title_capitalize", "part", ["p_partkey"], {"titled": "p_name.title()", "cap": "p_type.capitalize()"})


@query("str_capitalize", "select p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) as cap from part")
def str_capitalize(spark, sf):
    return compiler.select(table(spark, sf, "part"), {"cap": "p_type.capitalize()"}, ["p_partkey"])


expressions(
    "str_index",
    "part",
    ["p_partkey"],
    {"first": "p_brand.index('#')", "last": "p_name.rindex(' ')", "word": "p_brand.isalnum()", "code": "p_brand.removeprefix('Brand#').isalnum()", "big": "p_retailprice >= 950.0", "after": "p_name >= 'part 5'"},
    "select p_partkey, strpos(p_brand, '#') - 1 as first, length(p_name) - strpos(reverse(p_name), ' ') as last, false as word, regexp_full_match(replace(p_brand, 'Brand#', ''), '[a-zA-Z0-9]+') as code, p_retailprice >= 950 as big, p_name >= 'part 5' as after from part",
)


# -- lists and numbers ------------------------------------------------------------------------------------------------
def per_order(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("supps"), F.array_sort(F.collect_list("l_quantity")).alias("qty"))


_LISTS = "with g as (select l_orderkey, list_sort(list(l_suppkey)) as supps, list_sort(list(l_quantity)) as qty from lineitem group by 1) "


@query("list_ops", _LISTS + "select l_orderkey, supps as s, list_reverse(supps) as r, list_sort(list_distinct(supps)) as u, len(supps) as n, supps || [1, 2] as more, flatten([supps, supps]) as flat from g")
def list_ops(spark, sf):
    return compiler.select(per_order(spark, sf), {"s": "sorted(supps)", "r": "reversed(supps)", "u": "sorted(unique(supps))", "n": "len(supps)", "more": "supps + [1, 2]", "flat": "flatten([supps, supps])"}, ["l_orderkey"])


@query("list_aggs", _LISTS + "select l_orderkey, list_sum(supps) as total, list_min(supps) as low, list_max(qty) as high, len(list_filter(qty, lambda x: x > 49)) > 0 as some, len(list_filter(qty, lambda x: x > 2)) = len(qty) as every from g")
def list_aggs(spark, sf):
    return compiler.select(per_order(spark, sf), {"total": "sum(supps)", "low": "min(supps)", "high": "max(qty)", "some": "any([q > 49.0 for q in qty])", "every": "all([q > 2.0 for q in qty])"}, ["l_orderkey"])


@query("list_slice_index", "select vec_id, [round(cast(x as double), 6) for x in embedding[1:8]] as head, cast(embedding[-1] as double) as last, cast(embedding[3] as double) as third, len(embedding[2:]) as rest from embeddings")
def list_slice_index(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    out = compiler.select(df, {"head": "v[:8]", "last": "v[-1]", "third": "v[2]", "rest": "len(v[1:])"}, ["vec_id"])
    # what rounds to zero keeps its sign, as in SQL; Spark's round makes 0.0 of it
    return out.withColumn("head", F.transform("head", lambda x: F.when(F.abs(x) < 5e-7, x * 0.0).otherwise(F.round(x, 6))))


@query("list_comp", "select vec_id, len(list_filter(embedding, lambda x: cast(x as double) > 0.1)) as n, list_transform(range(0, 5), lambda i: i * i + label) as squares, list_filter(range(1, 20), lambda i: i % 3 = 0) as thirds from embeddings")
def list_comp(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return compiler.select(df, {"n": "len([x for x in v if x > 0.1])", "squares": "[i * i + label for i in range(5)]", "thirds": "[i for i in range(1, 20) if i % 3 == 0]"}, ["vec_id"])


expressions("round_half_even", "orders", ["o_orderkey"], {"whole": "round(o_totalprice)", "down": "floor(o_totalprice)", "up": "ceil(o_totalprice)", "half": "round(o_orderkey + 0.5)", "tens": "round(o_orderkey, -1)", "size": "abs(0 - o_orderkey)"}, "select o_orderkey, cast(round_even(o_totalprice, 0) as bigint) as whole, cast(floor(o_totalprice) as bigint) as down, cast(ceil(o_totalprice) as bigint) as up, cast(round_even(o_orderkey + 0.5, 0) as bigint) as half, cast(round_even(o_orderkey / 10.0, 0) * 10 as bigint) as tens, o_orderkey as size from orders")
expressions("conversions", "events", ["event_id"], {"i": "int(string(user_id))", "f": "float(user_id)", "s": "string(event_id) + ':' + event_type", "t": "bool('on')", "z": "bool(user_id)", "w": "int(2.0 * float(user_id))"}, "select event_id, user_id as i, cast(user_id as double) as f, event_id || ':' || event_type as s, true as t, user_id <> 0 as z, 2 * user_id as w from events")
expressions("regex_suite", "pages", ["page_id"], {"host": "re_search(url, '://([^/?#]*)')[1]", "https": "re_match(url, 'https') != null", "masked": "re_sub(url, '[0-9]+', '#')", "numbers": "re_findall(url, '[0-9]+')", "parts": "len(re_split(url, '/'))", "escaped": "re_escape('a.b') + url[:4]"}, "select page_id, regexp_extract(url, '://([^/?#]*)', 1) as host, starts_with(url, 'https') as https, regexp_replace(url, '[0-9]+', '#', 'g') as masked, regexp_extract_all(url, '[0-9]+') as numbers, len(string_split(url, '/')) as parts, 'a\\.b' || left(url, 4) as escaped from pages")
expressions("repr_literals", "nation", ["n_nationkey"], {"j": "repr_json(n_name)", "p": "repr_py([n_name, 'it\\'s'])", "s": "repr_sh(n_name + ' x')", "w": "repr_pwsh(n_nationkey > 3)", "c": "repr_cmd([n_name, 'a b'])"}, "select n_nationkey, '\"' || n_name || '\"' as j, '[''' || n_name || ''', ''it\\''s'']' as p, '''' || n_name || ' x''' as s, case when n_nationkey > 3 then '$true' else '$false' end as w, case when contains(n_name, ' ') then '\"' || n_name || '\"' else n_name end || ' \"a b\"' as c from nation")


# -- ranges -----------------------------------------------------------------------------------------------------------
@query("range_expand", "select r_regionkey, v from region, (select unnest(generate_series(1, 10, 2)) as v union all select 20)")
def range_expand(spark, sf):
    r = RangeExpr.parse("1-10:2,20")
    return table(spark, sf, "region").select("r_regionkey", F.explode(ranges.expand(r.column())).alias("v"))


expressions("range_len_contains", "orders", ["o_orderkey"], {"inside": "o_orderkey in range_expr('1-1000:7')", "n": "len(range_expr('1-1000:7'))", "shown": "string(range_expr('5,1-3'))", "total": "sum(range_expr('1-100'))", "third": "range_expr('1-10:2,20')[2]", "last": "range_expr('1-10:2,20')[-1]"}, "select o_orderkey, o_orderkey between 1 and 1000 and (o_orderkey - 1) % 7 = 0 as inside, cast(143 as bigint) as n, '1-3,5' as shown, cast(5050 as bigint) as total, cast(5 as bigint) as third, cast(20 as bigint) as last from orders")


@query("range_compress")
def range_compress(spark, sf):
    groups = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("s"))
    c = ranges.compress_column(F.col("s"))
    return groups.select("l_orderkey", ranges.display(c).alias("text"), ranges.length(c).alias("n"), space.chunk_text_column(F.col("s")).alias("chunk_text"))


expressions(
    "range_lists",
    "lineitem",
    ["l_orderkey", "l_linenumber"],
    {"all": "list(range_expr('3-9:2'))", "part": "string(range_expr('1-10:3,20-22')[1:3])", "from_text": "sum(list(range_expr('1-' + string(l_linenumber))))", "at": "range_expr('1-50')[l_linenumber]", "back": "range_expr('1-50')[0 - l_linenumber]"},
    "select l_orderkey, l_linenumber, [3, 5, 7, 9] as \"all\", '4,7' as part, cast(l_linenumber * (l_linenumber + 1) / 2 as bigint) as from_text, l_linenumber + 1 as at, 51 - l_linenumber as back from lineitem",
)


@query("range_islands", "with d as (select distinct o_orderkey // 3 * 2 as v from orders where o_orderkey % 7 <> 0 union select distinct o_custkey from orders), g as (select v, v - row_number() over (order by v) as k from d) select min(v) as start, max(v) - min(v) + 1 as length from g group by k")
def range_islands(spark, sf):
    orders = table(spark, sf, "orders")
    values = orders.where("o_orderkey % 7 <> 0").select((F.call_function("div", F.col("o_orderkey"), F.lit(3)) * 2).alias("v")).union(orders.select("o_custkey"))
    return space.islands(values, "v")


# -- parameter spaces -------------------------------------------------------------------------------------------------
def names_of(spark, sf, t: str, key: str, name: str) -> list[str]:
    """The names of a dimension table of a few rows, by key; a table with more than a dimension may list is an error."""
    names = [r[0] for r in table(spark, sf, t).orderBy(key).select(name).limit(space.MAX_LIST + 1).collect()]
    if len(names) > space.MAX_LIST:
        raise space.SpaceError(f"{t} has more than {space.MAX_LIST} rows")
    return names


def product_space(spark, sf) -> space.Space:
    return space.Space([space.Dimension("region", "STRING", names_of(spark, sf, "region", "r_regionkey", "r_name")), space.Dimension("nation", "STRING", names_of(spark, sf, "nation", "n_nationkey", "n_name")), space.Dimension("frame", "INT", RangeExpr.parse("1-10"))])


_PRODUCT = "select (row_number() over (order by r_regionkey, n_nationkey, f)) - 1 as task_index, r_name as region, n_name as nation, f as frame from region, nation, (select unnest(generate_series(1, 10)) as f)"


@query("space_product", _PRODUCT)
def space_product(spark, sf):
    return product_space(spark, sf).tasks(spark)


@query("space_random_access", f"select * from ({_PRODUCT}) where task_index between 600 and 604")
def space_random_access(spark, sf):
    return product_space(spark, sf).tasks(spark, 600, 605)


@query("space_association", "select n_nationkey as task_index, n_name as nation, n_nationkey * 3 + 1 as frame from nation")
def space_association(spark, sf):
    dims = [space.Dimension("nation", "STRING", names_of(spark, sf, "nation", "n_nationkey", "n_name")), space.Dimension("frame", "INT", RangeExpr.parse("1-73:3"))]
    return space.Space(dims, "(nation, frame)").tasks(spark).withColumn("task_index", F.col("task_index").cast("int")).withColumn("frame", F.col("frame").cast("int"))


@query("space_nested", "select r_regionkey * 25 + n_nationkey as task_index, r_name as region, n_name as nation, n_nationkey + 1 as frame from region, nation")
def space_nested(spark, sf):
    dims = [space.Dimension("region", "STRING", names_of(spark, sf, "region", "r_regionkey", "r_name")), space.Dimension("nation", "STRING", names_of(spark, sf, "nation", "n_nationkey", "n_name")), space.Dimension("frame", "INT", RangeExpr.parse("1-25"))]
    out = space.Space(dims, "region * (nation, frame)").tasks(spark)
    return out.withColumn("task_index", F.col("task_index").cast("int")).withColumn("frame", F.col("frame").cast("int"))


@query("chunk_static", "with n as (select *, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders), s as (select *, (n + 9) // 10 as c from n) select o_orderpriority, o_orderkey, case when i < (n % c) * (n // c + 1) then i // (n // c + 1) else n % c + (i - (n % c) * (n // c + 1)) // (n // c) end as chunk from s")
def chunk_static(spark, sf):
    return space.static_chunks(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey"), "o_orderkey", 10, ["o_orderpriority"])


@query(
    "chunk_contiguous",
    """with g as (select o_orderkey as v, o_orderkey - row_number() over (order by o_orderkey) as k from orders where o_orderkey % 37 <> 0),
 isl as (select min(v) as start, count(*) as length from g group by k),
 c as (select *, (length + 9) // 10 as cc from isl),
 s as (select *, case when cc >= length then 1 when cc <= 1 then length else length // cc end as small, case when cc >= length or cc <= 1 then 0 else length % cc end as lo from c),
 e as (select *, unnest(range(0, cc)) as chunk from s)
 select start, length, chunk, start + chunk * small + least((chunk * lo + cc - 1) // cc, lo) as first, start + (chunk + 1) * small + least(((chunk + 1) * lo + cc - 1) // cc, lo) - 1 as last from e""",
)
def chunk_contiguous(spark, sf):
    runs = space.islands(table(spark, sf, "orders").where("o_orderkey % 37 <> 0"), "o_orderkey")
    return space.contiguous_chunks(runs, "start", "length", 10)


@query("space_containment", "select o_orderkey, o_orderpriority from orders where o_orderkey between 1 and 9999 and (o_orderkey - 1) % 3 = 0 and o_orderpriority in ('1-URGENT', '2-HIGH')")
def space_containment(spark, sf):
    dims = [space.Dimension("o_orderkey", "INT", RangeExpr.parse("1-9999:3")), space.Dimension("o_orderpriority", "STRING", ["1-URGENT", "2-HIGH"])]
    return space.Space(dims).contains(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"))


# -- manifests --------------------------------------------------------------------------------------------------------
def doc_manifest(spark, sf, docs: DataFrame | None = None) -> Manifest:
    d = docs if docs is not None else table(spark, sf, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return Manifest.of(d.select(path.alias("path"), F.md5("text").alias("hash"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime")))


_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
_BASE = f"select {_PATH} as path, md5(text) as hash, n_chars as size, doc_id * 1000 as mtime, doc_id from documents"


@query("manifest_from_docs", f"select path, hash, size, mtime from ({_BASE})")
def manifest_from_docs(spark, sf):
    return doc_manifest(spark, sf).files.select("path", "hash", "size", "mtime")


@query("manifest_total_size", "select sum(n_chars) as total, count(*) as files from documents")
def manifest_total_size(spark, sf):
    files = doc_manifest(spark, sf).files
    return files.agg(F.sum(F.when(manifest.live(), F.col("size"))).alias("total"), F.count("*").alias("files"))


@query("manifest_filter_glob", f"select path, size from ({_BASE}) where (path glob 'src1*' or path glob '*/de/*') and not path glob '*7.txt'")
def manifest_filter_glob(spark, sf):
    m = doc_manifest(spark, sf)
    return manifest.filter_manifest(m, manifest.glob_filter(F.col("path"), ["src1*", "*/de/*"], ["*7.txt"])).files.select("path", "size")


def mutated(spark, sf) -> Manifest:
    """The documents' manifest after a day: some gone, some grown, some new."""
    base = doc_manifest(spark, sf)
    number = F.call_function("div", F.col("mtime"), F.lit(1000))
    kept = base.files.where(number % 7 != 0).withColumn("size", F.when(number % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    fresh = base.files.where(number % 11 == 0).withColumn("path", F.concat(F.lit("new/"), F.col("path")))
    return base.with_files(kept.unionByName(fresh))


_CURRENT = f"select path, hash, case when doc_id % 5 = 0 then size + 1 else size end as size, mtime, doc_id from ({_BASE}) where doc_id % 7 <> 0 union all select 'new/' || path, hash, size, mtime, doc_id from ({_BASE}) where doc_id % 11 = 0"
_DIFF = f"select coalesce(c.path, p.path) as path, c.size as size, c.path is null as deleted from ({_BASE}) p full join ({_CURRENT}) c on p.path = c.path where p.path is null or c.path is null or p.size <> c.size"


@query("manifest_diff", _DIFF)
def manifest_diff(spark, sf):
    return manifest.diff(doc_manifest(spark, sf), mutated(spark, sf)).files.select("path", "size", "deleted")


_CHARACTER = "case when c = '\"' then '\\\"' when c = '\\' then '\\\\' when u = 8 then '\\b' when u = 9 then '\\t' when u = 10 then '\\n' when u = 12 then '\\f' when u = 13 then '\\r' when u between 32 and 127 then c when u < 65536 then printf('\\u%04x', u) else printf('\\u%04x', 55296 + (u - 65536) // 1024) || printf('\\u%04x', 56320 + (u - 65536) % 1024) end"


@query(
    "json_canonical",
    f"""with c as (select doc_id, unnest(regexp_extract_all(text, '(?s).')) as c, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) as i from documents), u as (select *, unicode(c) as u from c)
 select d.doc_id, case when text is not null then '"' || coalesce(j, '') || '"' end as json from documents d left join (select doc_id, string_agg({_CHARACTER}, '' order by i) as j from u group by doc_id) e on e.doc_id = d.doc_id""",
)
def json_canonical(spark, sf):
    """Whole texts as canonical JSON strings."""
    return table(spark, sf, "documents").select("doc_id", manifest_text.json_text(F.col("text")).alias("json"))


@query(
    "manifest_encode",
    f"""with d as (select path, row_number() over (order by path) - 1 as place from (select source as path from documents union select source || '/' || lang from documents)), f as (select m.*, d.place from ({_BASE}) m join d on m.path = d.path || '/' || doc_id || '.txt')
 select 0 as section, '{{"name":"' || coalesce('$' || p.place || '/' || split_part(d.path, '/', -1), d.path) || '"}}' as entry from d left join d p on p.path = regexp_extract(d.path, '^(.*)/[^/]*$', 1)
 union all select 1, '{{' || coalesce('"hash":"' || hash || '",', '') || '"mtime":' || mtime || ',"name":"$' || place || '/' || doc_id || '.txt"' || coalesce(',"size":' || size, '') || '}}' from f""",
)
def manifest_encode(spark, sf):
    """The entries of the documents' manifest with indexed directories."""
    entries, _ = manifest_text.entries_v2025(doc_manifest(spark, sf), Tables(spark))
    return entries.select("section", F.concat("text", F.lit("}")).alias("entry"))


@query("manifest_round_trip", f"select path, hash, size, mtime from ({_BASE})")
def manifest_round_trip(spark, sf):
    """The documents' manifest written as canonical text to the shared folder and read back by ranges of bytes."""
    tables = Tables(spark)
    folder = tables.place()
    manifest_text.write_manifest(doc_manifest(spark, sf), folder)
    return manifest_text.read_manifest(spark, folder, tables=tables).files.select("path", "hash", "size", "mtime")


@query("manifest_compose", f"select path, size, hash from ({_CURRENT}) where path not like 'new/src1/%' ")
def manifest_compose(spark, sf):
    base, current = doc_manifest(spark, sf), mutated(spark, sf)
    first = manifest.diff(base, current)
    gone = current.files.where(F.startswith("path", F.lit("new/src1/"))).select(*manifest.deleted_file(F.col("path")))
    return manifest.compose(base, [first, first.with_files(gone)]).files.select("path", "size", "hash")


@query("manifest_compose_diffs", f"select path, size, deleted from ({_DIFF}) where path not like 'new/src1/%' union all select path, null, true from ({_DIFF}) where path like 'new/src1/%'")
def manifest_compose_diffs(spark, sf):
    """Two diffs as one: what the second takes is deleted, and what the first changed stays changed."""
    base, current = doc_manifest(spark, sf), mutated(spark, sf)
    first = manifest.diff(base, current)
    gone = first.files.where(F.startswith("path", F.lit("new/src1/"))).select(*manifest.deleted_file(F.col("path")))
    return manifest.compose_diffs([first, first.with_files(gone)]).files.select("path", "size", "deleted")


@query("manifest_compose_law", "select 0 as missing, 0 as extra, count(*) as files from (" + _CURRENT + ")")
def manifest_compose_law(spark, sf):
    base, current = doc_manifest(spark, sf), mutated(spark, sf)
    got = manifest.compose(base, [manifest.diff(base, current)]).files
    both = got.select("path", "size", "hash", F.lit(1).alias("g"), F.lit(0).alias("w")).union(current.files.select("path", "size", "hash", F.lit(0).alias("g"), F.lit(1).alias("w")))
    seen = both.groupBy("path", "size", "hash").agg(F.max("g").alias("g"), F.max("w").alias("w"))
    return seen.agg(F.count_if((F.col("g") == 0)).cast("int").alias("missing"), F.count_if(F.col("w") == 0).cast("int").alias("extra"), F.count_if(F.col("w") == 1).alias("files"))


@query("manifest_compose_dirs", "select distinct source as path from documents union select distinct source || '/' || lang from documents")
def manifest_compose_dirs(spark, sf):
    return manifest.compose(doc_manifest(spark, sf), []).dirs.select("path")


@query("manifest_subtree", f"select substr(path, 6) as path, size from ({_BASE}) where path like 'src1/%'")
def manifest_subtree(spark, sf):
    return manifest.subtree(doc_manifest(spark, sf), "src1").files.select("path", "size")


@query("manifest_join_prefix", f"select '/data/v1/' || path as path, size from ({_BASE})")
def manifest_join_prefix(spark, sf):
    return manifest.join_prefix(doc_manifest(spark, sf), "/data/./x/../v1").files.select("path", "size")


@query("manifest_partition", "select source as root, count(*) as files, sum(n_chars) as size from documents where source in ('src1', 'src2', 'src3') group by source")
def manifest_partition(spark, sf):
    held = manifest.assign_roots(doc_manifest(spark, sf).files, ["src1", "src2", "src3"])
    return held.groupBy("root").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


@query("manifest_common_root", "select source, case when count(distinct lang) = 1 then source || '/' || min(lang) else source end as root from documents group by source")
def manifest_common_root(spark, sf):
    tops = doc_manifest(spark, sf).files.select(manifest.parent_of(F.col("path")).alias("path")).withColumn("source", F.substring_index("path", "/", 1))
    return manifest.longest_common_prefix(tops, ["source"])


@query("manifest_order_utf16")
def manifest_order_utf16(spark, sf):
    files = doc_manifest(spark, sf).files.select(F.concat("path", F.when(F.col("size") % 2 == 0, F.lit("\U0001f600")).otherwise(F.lit("￮"))).alias("path"))
    return files.orderBy(F.encode("path", "UTF-16BE"))


@query("manifest_validate", f"select path, 'file without size' as problem from ({_BASE}) where doc_id % 9 = 0 union all select path, 'duplicate path' from ({_BASE}) where doc_id % 10 = 0")
def manifest_validate(spark, sf):
    m = doc_manifest(spark, sf)
    number = F.call_function("div", F.col("mtime"), F.lit(1000))
    bad = m.files.withColumn("size", F.when(number % 9 != 0, F.col("size")))
    twice = m.files.where(number % 10 == 0)
    return manifest.violations(m.with_files(bad.unionByName(twice)))


@query("hash_cache_fresh", f"select path, case when doc_id % 2 = 0 and doc_id % 3 <> 0 then hash end as cached from ({_BASE})")
def hash_cache_fresh(spark, sf):
    m = doc_manifest(spark, sf)
    chunks = content.chunk_rows(m.files, manifest.WHOLE_FILE).withColumn("alg", F.lit("xxh128"))
    number = F.call_function("div", F.col("mtime"), F.lit(1000))
    cache = chunks.where(number % 3 != 0).select("path", "alg", "range_start", "range_end", "hash", F.when(number % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1).alias("mtime"))
    return content.fresh(chunks, cache).select("path", "cached")


@query("cache_sync_plan", "with w as (select md5(text) as hash, max(n_chars) as size from documents group by 1), s as (select distinct md5(text) as hash from documents where doc_id % 5 <> 0), t as (select distinct md5(text) as hash from documents where doc_id % 3 = 0) select hash, size, case when hash in (select hash from t) then 'skip' when hash in (select hash from s) then 'copy' else 'absent' end as action from w")
def cache_sync_plan(spark, sf):
    docs = table(spark, sf, "documents")
    held = lambda keep: docs.where(keep).select(F.md5("text").alias("hash"), F.lit("xxh128").alias("alg"))
    return content.sync_plan([doc_manifest(spark, sf)], held("doc_id % 5 <> 0"), held("doc_id % 3 = 0")).select("hash", "size", "action")


@query("hash_upsert", "select p_partkey % 100 as k, max(p_partkey) as v from part group by 1")
def hash_upsert(spark, sf):
    rows = table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("k"), F.col("p_partkey").alias("v"))
    return manifest.latest_wins(rows, ["k"], "v")


_SIZES = "(o_orderkey * 100 + 4) * (case o_orderkey % 4 when 0 then 1 when 1 then 1000 when 2 then 1000000 else 1000000000 end) - o_orderkey % 7 + o_orderkey % 3 * 999500"


@query("human_size", f"""
with n as (select o_orderkey, cast({_SIZES} as double) as b from orders),
u as (select unnest([0, 1, 2, 3, 4, 5, 6]) as k, unnest(['B', 'KB', 'MB', 'GB', 'TB', 'PB', 'EB']) as unit),
r as (select o_orderkey, k, unit, floor(b / power(1000.0, k) * 100 + 0.5) / 100 as v from n, u)
select o_orderkey, regexp_replace(cast(arg_min(v, k) as varchar), '\\.0$', '') || ' ' || arg_min(unit, k) as shown from r where v < 1000 group by o_orderkey""")
def human_size(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", content.human_size(F.expr(_SIZES)).alias("shown"))


# -- parameters and graphs --------------------------------------------------------------------------------------------
def part_definitions(spark, sf) -> DataFrame:
    """Two definitions of a size parameter for each brand, from its parts."""
    part = table(spark, sf, "part")
    of = lambda keep, at: part.where(keep).groupBy("p_brand").agg(F.min("p_size").cast("long").alias("min_value"), F.max("p_size").cast("long").alias("max_value"), F.array_sort(F.collect_set("p_type")).alias("allowed")).select(F.col("p_brand").alias("name"), F.lit(at).alias("position"), F.lit("INT").alias("type"), "min_value", "max_value", F.lit(None).cast("long").alias("min_length"), F.lit(None).cast("long").alias("max_length"), "allowed", F.lit(None).cast("string").alias("default"))
    return of("p_partkey % 2 = 0", 0).union(of("p_partkey % 2 = 1", 1))


_MERGE = "with d as (select p_brand as name, p_partkey % 2 as side, min(p_size) as lo, max(p_size) as hi, list(distinct p_type) as types from part group by 1, 2) select name, cast(max(lo) as bigint) as min_value, cast(min(hi) as bigint) as max_value, len(case when count(*) = 1 then any_value(types) else list_intersect(max_by(types, side), min_by(types, side)) end) as n_allowed, case when max(lo) > min(hi) then 'no valid range' when len(case when count(*) = 1 then any_value(types) else list_intersect(max_by(types, side), min_by(types, side)) end) = 0 then 'no common allowed values' end as problem from d group by name"


@query("param_merge", _MERGE)
def param_merge(spark, sf):
    return model.merge_frame(part_definitions(spark, sf)).select("name", "min_value", "max_value", F.size("allowed").cast("long").alias("n_allowed"), "problem")


@query("constraint_check", "select p_partkey, p_size between 5 and 40 as size_ok, strlen(p_name) <= 20 as name_ok, p_brand in ('Brand#11', 'Brand#12', 'Brand#13') as brand_ok from part")
def constraint_check(spark, sf):
    part = table(spark, sf, "part")
    size, name, brand = {"type": "INT", "minValue": 5, "maxValue": 40}, {"type": "STRING", "maxLength": 20}, {"type": "STRING", "allowedValues": ["Brand#11", "Brand#12", "Brand#13"]}
    return part.select("p_partkey", model.constraint(F.col("p_size"), size).alias("size_ok"), model.constraint(F.col("p_name"), name).alias("name_ok"), model.constraint(F.col("p_brand"), brand).alias("brand_ok"))


def chain(spark, sf) -> DataFrame:
    """Each nation depends on its region and on the nation two before it."""
    nation = table(spark, sf, "nation")
    to_region = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("step"), F.concat(F.lit("r"), "n_regionkey").alias("depends_on"))
    to_nation = nation.where("n_nationkey >= 2").select(F.concat(F.lit("n"), "n_nationkey").alias("step"), F.concat(F.lit("n"), (F.col("n_nationkey") - 2).cast("string")).alias("depends_on"))
    return to_region.union(to_nation)


_EDGES = "select 'n' || n_nationkey as step, 'r' || n_regionkey as depends_on from nation union all select 'n' || n_nationkey, 'n' || (n_nationkey - 2) from nation where n_nationkey >= 2"


@query("dag_closure", f"with recursive e as ({_EDGES}), reach(name, depth) as (select 'n20', 0 union all select e.depends_on, depth + 1 from reach join e on e.step = reach.name) select name, max(depth) as depth from reach group by name")
def dag_closure(spark, sf):
    return model.closure(chain(spark, sf), spark.createDataFrame([("n20",)], "name string"))


@query("dag_degrees", f"with e as ({_EDGES}) select (select max(n) from (select count(*) as n from e group by step)) as max_in_degree, (select max(n) from (select count(*) as n from e group by depends_on)) as max_out_degree")
def dag_degrees(spark, sf):
    return model.degrees(chain(spark, sf))


def order_graph(spark, sf) -> DataFrame:
    """Each order depends on its customer's order before it and on its parts, each part on its suppliers."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    chain_ = orders.select("o_orderkey", before.alias("before")).where("before is not null").select(named("o", "o_orderkey").alias("step"), named("o", "before").alias("depends_on"))
    return chain_.union(lines.select(named("o", "l_orderkey"), named("p", "l_partkey"))).union(lines.select(named("p", "l_partkey"), named("s", "l_suppkey")))


@query("dag_closure_orders", """with o as (select o_orderkey as k, row_number() over (partition by o_custkey order by o_orderkey desc) - 1 as depth from orders),
p as (select l_partkey as k, max(depth) + 1 as depth from lineitem join o on k = l_orderkey group by 1), s as (select l_suppkey as k, max(depth) + 1 as depth from lineitem join p on k = l_partkey group by 1)
select 'o' || k as name, cast(depth as int) as depth from o union all select 'p' || k, cast(depth as int) from p union all select 's' || k, cast(depth as int) from s""")
def dag_closure_orders(spark, sf):
    last = table(spark, sf, "orders").groupBy("o_custkey").agg(F.concat(F.lit("o"), F.max("o_orderkey").cast("string")).alias("name")).select("name")
    return model.closure(order_graph(spark, sf), last)


@query("dag_order", """with has as (select distinct l_orderkey from lineitem), o as (select o_orderkey as k, row_number() over w as i, case when l_orderkey is null then 0 else 2 end - row_number() over w as base, o_custkey as c from orders left join has on l_orderkey = o_orderkey window w as (partition by o_custkey order by o_orderkey))
select 'o' || k as name, cast(i + max(base) over (partition by c order by i) as int) as level from o union all select distinct 'p' || l_partkey, 1 from lineitem union all select distinct 's' || l_suppkey, 0 from lineitem""")
def dag_order(spark, sf):
    steps = table(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"))
    return model.order_of_steps(steps, order_graph(spark, sf))


def job_template(spark, sf) -> model.Template:
    regions = names_of(spark, sf, "region", "r_regionkey", "r_name")
    run = {"actions": {"onRun": {"command": "render", "args": ["{{Task.Param.Frame}}", "{{Param.Scene}}"]}}}
    return model.decode_job({
        "specificationVersion": model.JOB_VERSION,
        "name": "job {{Param.Scene}}",
        "extensions": ["TASK_CHUNKING"],
        "parameterDefinitions": [{"name": "Scene", "type": "STRING", "default": "s1"}, {"name": "Last", "type": "INT", "default": 100, "minValue": 1}],
        "steps": [
            {"name": "Render", "parameterSpace": {"taskParameterDefinitions": [{"name": "Region", "type": "STRING", "range": regions}, {"name": "Frame", "type": "INT", "range": "1-{{Param.Last}}"}]}, "script": run},
            {"name": "Pack", "dependencies": [{"dependsOn": "Render"}], "parameterSpace": {"taskParameterDefinitions": [{"name": "Frame", "type": "CHUNK[INT]", "range": "1,10-12,18-50", "chunks": {"defaultTaskCount": 10, "rangeConstraint": "CONTIGUOUS"}}]}, "script": run},
            {"name": "End", "dependencies": [{"dependsOn": "Pack"}], "script": {"actions": {"onRun": {"command": "end"}}}},
        ],
    })


@query("job_summary", "select 'Render' as step, cast((select count(*) from region) * 100 as int) as tasks, 2 as parameters, 0 as dependencies union all select 'Pack', cast((select count(*) from (select 1 union all select unnest(generate_series(10, 12)) union all select unnest(generate_series(18, 50)))) as int), 1, 1 union all select 'End', 1, 0, 1")
def job_summary(spark, sf):
    job = model.create_job(spark, job_template(spark, sf))
    steps = model.summary(spark, job)[1]
    return steps.select("step", *[F.col(c).cast("int").alias(c) for c in ("tasks", "parameters", "dependencies")])


@query("job_tasks", "select r_regionkey * 100 + f - 1 as task_index, r_name as \"Region\", f as \"Frame\", 'render' as command, f || ' s1' as line from region, (select unnest(generate_series(1, 100)) as f)")
def job_tasks(spark, sf):
    job = model.create_job(spark, job_template(spark, sf))
    out = model.action_frame(job, "Render", job.step("Render").space.tasks(spark))
    return out.select(F.col("task_index"), "Region", "Frame", "command", F.array_join("args", " ").alias("line"))


@query("job_chunks", "select * from (values ('1-1', 0), ('10-12', 1), ('18-26', 2), ('27-34', 3), ('35-42', 4), ('43-50', 5)) t(\"Frame\", task_index)")
def job_chunks(spark, sf):
    job = model.create_job(spark, job_template(spark, sf))
    return job.step("Pack").space.tasks(spark).select("Frame", F.col("task_index").cast("int").alias("task_index"))


# -- directives -------------------------------------------------------------------------------------------------------
def event_lines(spark, sf) -> DataFrame:
    """Directive lines made from events."""
    v, p = F.col("value"), directives.PREFIX
    n = F.floor(v).cast("string")
    line = (
        F.when(F.col("event_id") % 6 == 0, F.concat(F.lit(f"{p}progress: "), n))
        .when(F.col("event_id") % 6 == 1, F.concat(F.lit(f"{p}status: "), "event_type"))
        .when(F.col("event_id") % 6 == 2, F.concat(F.lit(f"{p}env: "), F.upper("event_type"), F.lit("="), n))
        .when(F.col("event_id") % 6 == 3, F.concat(F.lit(f"{p}unset_env: "), F.upper("event_type")))
        .when(F.col("event_id") % 60 == 4, F.concat(F.lit(f"{p}fail: at "), n))
        .otherwise(F.concat(F.lit("plain "), "event_type"))
    )
    return table(spark, sf, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_id").alias("seq"), line.alias("line"))


_E = "select *, 's' || user_id as session_id, event_id as seq, cast(floor(value) as bigint) as n, event_id % 6 as m from events"


@query("directive_parse", f"select session_id, seq, case when m = 0 then 'progress' when m = 1 then 'status' when m = 2 then 'env' when m = 3 then 'unset_env' when event_id % 60 = 4 then 'fail' end as kind, case when m = 0 and n between 0 and 100 then cast(n as double) end as number, case when m in (2, 3) then upper(event_type) end as name, case when m = 2 then cast(n as varchar) end as value, event_id % 60 = 4 and m = 4 as fails from ({_E})")
def directive_parse(spark, sf):
    return directives.parse(event_lines(spark, sf)).select("session_id", "seq", "kind", "number", "name", "value", "fails")


_STATUS_SQL = f"select session_id, max_by(case when m = 0 and n between 0 and 100 then cast(n as double) end, case when m = 0 and n between 0 and 100 then seq end) as progress, max_by(event_type, case when m = 1 then seq end) as status_message, max_by('at ' || n, case when event_id % 60 = 4 then seq end) as fail_message from ({_E}) group by session_id"


@query("action_status_fold", _STATUS_SQL)
def action_status_fold(spark, sf):
    return directives.action_status(directives.parse(event_lines(spark, sf))).select("session_id", "progress", "status_message", "fail_message")


def stream_folder(spark: SparkSession) -> str:
    """A folder for a stream's files where driver and executors share one; it goes when the driver ends."""
    import uuid

    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    Tables(spark).paths.append(root)
    return root


@query("directive_stream", _STATUS_SQL)
def directive_stream(spark, sf):
    """The same fold as a stream over files of lines, in the folder that driver and executors share."""
    root = stream_folder(spark)
    event_lines(spark, sf).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("session_id string, seq long, line string").parquet(f"{root}/in")
    directives.run_available(directives.status_stream(stream), f"{root}/out", f"{root}/state")
    rows = spark.read.parquet(f"{root}/out")
    return rows.groupBy("session_id").agg(*[F.max_by(c, "seq").alias(c) for c in ("progress", "status_message", "fail_message")])


@query("env_layering", f"select session_id, seq, upper(event_type) as name, case when m = 2 then cast(n as varchar) end as current from ({_E}) where m in (2, 3)")
def env_layering(spark, sf):
    rows = directives.parse(event_lines(spark, sf)).where("kind in ('env', 'unset_env')").select("session_id", F.col("seq").alias("position"), "name", "value")
    return directives.layered(rows, ["session_id"]).select("session_id", F.col("position").alias("seq"), "name", "current")


@query("env_final", f"select session_id, upper(event_type) as name, max_by(cast(n as varchar), seq) as value from ({_E}) where m in (2, 3) group by 1, 2 having max_by(m, seq) = 2")
def env_final(spark, sf):
    return directives.environment(directives.parse(event_lines(spark, sf)))


@query("redact_lines", f"""with e as ({_E}), s as (select *, list(event_type) filter (seq % 12 = 1) over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as secrets,
case m when 0 then '{directives.PREFIX}progress: ' || n || case when n between 0 and 100 then '' else ' -- ERROR: {directives.PROGRESS_ERROR}' end when 1 then '{directives.PREFIX}status: ' || event_type when 2 then '{directives.PREFIX}env: ' || upper(event_type) || '=' || n when 3 then '{directives.PREFIX}unset_env: ' || upper(event_type)
else case when event_id % 60 = 4 then '{directives.PREFIX}fail: at ' || n else 'plain ' || event_type end end as line from e)
select session_id, seq, case when seq % 12 = 1 then '{directives.PREFIX}redacted_env: TOKEN={directives.MASK}' else list_reduce(list_concat([line], coalesce(secrets, [])), lambda a, b: replace(a, b, '{directives.MASK}')) end as shown from s""")
def redact_lines(spark, sf):
    lines = event_lines(spark, sf)
    secret = lines.where("seq % 12 = 1").withColumn("line", F.concat(F.lit(f"{directives.PREFIX}redacted_env: TOKEN="), F.substring_index("line", " ", -1)))
    rest = lines.where("seq % 12 <> 1")
    return directives.redacted(directives.parse(rest.union(secret))).select("session_id", "seq", "shown")


def event_samples(spark, sf) -> DataFrame:
    """(user_id, ts, amount): each user's running sum of values, in hundredths."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.sum(F.floor(F.col("value") * 100).cast("long")).over(w).alias("amount"))


_AMOUNTS = "select user_id, epoch_us(ts) / 1e6 as s, cast(sum(cast(floor(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as amount from events"


@query("sliding_rate", f"""with a as (select user_id, s - min(s) over (partition by user_id) as seconds, amount from ({_AMOUNTS})),
f as (select *, max({{'t': seconds, 'v': amount}}) over (partition by user_id order by seconds range between unbounded preceding and 3600.0 preceding) as p from a)
select user_id, seconds, amount, case when seconds > coalesce(p.t, 0) then (amount - coalesce(p.v, 0)) / (seconds - coalesce(p.t, 0)) else 0 end as rate from f""")
def sliding_rate(spark, sf):
    s = F.unix_micros("ts") / 1e6
    samples = event_samples(spark, sf).select("user_id", (s - F.min(s).over(Window.partitionBy("user_id"))).alias("seconds"), "amount")
    return directives.sliding_rate(samples, "user_id", "seconds", "amount", 3600.0)


@query("rate_stream", f"""with a as ({_AMOUNTS}), f as (select *, max({{'t': s, 'v': amount}}) over (partition by user_id order by s range between unbounded preceding and 3600.0 preceding) as p from a)
select user_id, s as seconds, cast(amount as double) as amount, case when s > coalesce(p.t, 0) then (amount - coalesce(p.v, 0)) / (s - coalesce(p.t, 0)) else 0 end as rate from f where s <= (select max(s) - 60 from a)""")
def rate_stream(spark, sf):
    """The same rates as a stream over files of samples, up to its last watermark."""
    root = stream_folder(spark)
    event_samples(spark, sf).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("user_id long, ts timestamp, amount long").parquet(f"{root}/in")
    directives.run_available(directives.rate_stream(stream, "user_id", "ts", "amount", 3600.0, "60 seconds"), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


_CHUNKS = """with t as (select user_id, event_id, row_number() over w as k, sum(floor(value)) over w as s, cast(sum(1 + event_id % 7) over w as bigint) as n from events window w as (partition by user_id order by event_id rows unbounded preceding)),
i as (select *, case when s > 0 then 30.0::double / (s / n) else 1000.0::double end as ideal from t),
l as (select *, list(ideal) filter (k < 10) over (partition by user_id order by event_id rows unbounded preceding) as first9 from i),
z as (select *, cast(case when k < 10 then list_reduce(list_concat([5.0::double], first9), lambda a, b: greatest(1.0, floor(case when b > a then 0.75::double * a + 0.25::double * b else b end))) else greatest(1.0, floor(ideal)) end as bigint) as size from l),
p as (select *, least(1000, 5 + coalesce(sum(size) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)) as f from z)
select user_id, event_id, size, cast(f as bigint) as first, cast(least(1000, f + size) as bigint) as "end" from p"""


def finished_tasks(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", F.floor("value").cast("double").alias("seconds"), (1 + F.col("event_id") % 7).alias("values"))


@query("adaptive_chunks", _CHUNKS)
def adaptive_chunks(spark, sf):
    return space.adaptive_chunks(finished_tasks(spark, sf), "user_id", "event_id", "seconds", "values", 5, 30.0, 1000)


@query("adaptive_chunk_stream", _CHUNKS)
def adaptive_chunk_stream(spark, sf):
    """The same chunks, given out as a stream of finished tasks arrives."""
    root = stream_folder(spark)
    finished_tasks(spark, sf).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("user_id long, event_id long, seconds double, values long").parquet(f"{root}/in")
    directives.run_available(chunks.chunk_stream(stream, "user_id", "event_id", "seconds", "values", 5, 30.0, 1000), f"{root}/out", f"{root}/state")
    return spark.read.parquet(f"{root}/out")


# -- paths and hashes -------------------------------------------------------------------------------------------------
@query("path_mapping", "select page_id, case when regexp_matches(p, '^/web/http/') then '/mnt' || substr(p, 10) when regexp_matches(p, '^/web/') then '/all' || substr(p, 5) else p end as mapped from (select page_id, '/web/' || regexp_extract(url, '^[a-z]+') || '/' || regexp_extract(url, '://([^/?#]*)', 1) as p from pages)")
def path_mapping(spark, sf):
    p = F.concat(F.lit("/web/"), F.regexp_extract("url", "^[a-z]+", 0), F.lit("/"), F.regexp_extract("url", "://([^/?#]*)", 1))
    rules = paths.longest_first([paths.Rule("POSIX", "/web", "/all"), paths.Rule("POSIX", "/web/http", "/mnt")])
    return paths.map_paths(table(spark, sf, "pages").select("page_id", p.alias("p")), "p", rules).select("page_id", "mapped")


@query("uri_mapping", "select page_id, case when regexp_matches(lower(url), '^http://therha.example.com/en(/|$)') then '/mnt/en' || substr(url, 29) else url end as mapped from pages")
def uri_mapping(spark, sf):
    return paths.map_paths(table(spark, sf, "pages"), "url", [paths.Rule("URI", "HTTP://therha.example.com/en", "/mnt/en")]).select("page_id", "mapped")


_HOSTS = "select *, case page_id % 3 when 0 then '/web/' || host || '/' || page_id || '/' when 1 then 'C:\\WEB\\' || upper(host) || '\\' || page_id else url end as p from (select page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) as host from pages)"


@query("path_rules", f"""with p as ({_HOSTS}), h as (select host, count(*) as n from p group by host having count(*) > 1)
select page_id, case page_id % 3 when 0 then coalesce('/h/' || n, '/all/' || host) || '/' || page_id || '/' when 1 then coalesce('/w/' || n || '/' || page_id, p)
else case when n is not null and regexp_matches(lower(url), '^https?://[^/]*/en(/|$)') then '/mnt/' || n || substr(url, length(regexp_extract(url, '^[a-zA-Z]+://[^/]*/en')) + 1) else url end end as mapped from p left join h using (host)""")
def path_rules(spark, sf):
    """Paths of three formats by rules that are made from the pages' hosts."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    pages = table(spark, sf, "pages").select("page_id", "url", host.alias("host"))
    own = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/web/"), "host", F.lit("/"), "page_id", F.lit("/"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("C:\\WEB\\"), F.upper("host"), F.lit("\\"), "page_id")).otherwise(F.col("url"))
    hosts = pages.groupBy("host").agg(F.count("*").alias("n")).where("n > 1")
    rule = lambda kind, source, to, at: hosts.select(F.lit(kind).alias("source_format"), F.concat(F.lit(source), "host", F.lit("/en" if kind == "URI" else "")).alias("source"), F.concat(F.lit(to), F.col("n").cast("string")).alias("destination"), F.lit(at).alias("position"))
    rules = rule("POSIX", "/web/", "/h/", 0).union(rule("WINDOWS", "c:/web/", "/w/", 1)).union(rule("URI", "HTTP://", "/mnt/", 2)).union(rule("URI", "https://", "/mnt/", 3))
    rules = rules.union(hosts.agg(F.lit("POSIX"), F.lit("/web"), F.lit("/all"), F.lit(4)))
    return paths.map_by_rules(pages.select("page_id", own.alias("p")), "p", rules).select("page_id", "mapped")


@query("path_props", f"select path, regexp_extract(path, '[^/]*$') as name, doc_id || '' as stem, '.txt' as suffix, source || '/' || lang as parent, is_sub from (select {_PATH} as path, *, source = 'src1' as is_sub from documents)")
def path_props(spark, sf):
    df = doc_manifest(spark, sf).files.select("path").withMetadata("path", {"path_format": "POSIX"})
    return compiler.select(df, {"name": "path.name", "stem": "path.stem", "suffix": "path.suffix", "parent": "string(path.parent)", "is_sub": "path.is_relative_to('src1')"}, ["path"])


@query(
    "path_edits",
    f"""select path, source || '/' || lang || '/x.dat' as named, source || '/' || lang || '/s.txt' as stemmed, source || '/' || lang || '/' || doc_id || '.exr' as suffixed, source || '/' || lang || '/' || lpad('7', cast(length(doc_id || '') as int), '0') || '.txt' as numbered,
path as posix, false as rooted, true as absolute, case when source = 'src1' then lang || '/' || doc_id || '.txt' else path end as relative, ['.txt'] as ends, [source, lang, doc_id || '.txt'] as steps, '/mnt/' || path as joined from (select {_PATH} as path, * from documents)""",
)
def path_edits(spark, sf):
    posix = {"path_format": "POSIX"}
    df = doc_manifest(spark, sf).files.select("path", F.concat(F.lit("/"), "path").alias("abs")).withMetadata("path", posix).withMetadata("abs", posix)
    made = {
        "named": "string(path.with_name('x.dat'))", "stemmed": "string(path.with_stem('s'))", "suffixed": "string(path.with_suffix('.exr'))", "numbered": "string(path.with_number(7))", "posix": "path.as_posix()", "rooted": "path.is_absolute()",
        "absolute": "abs.is_absolute()", "relative": "string(path.relative_to('src1')) if path.is_relative_to('src1') else string(path)", "ends": "path.suffixes", "steps": "path.parts", "joined": "string(path('/mnt') / path)",
    }
    return compiler.select(df, made, ["path"])


@query("xxh_hash")
def xxh_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content.hash_text(F.col("text")).alias("hash"))
