"""Queries over names, imports, calls, the graph and the impact walk.

The trade tables are read as a repository: every part, supplier, order, customer, nation and
region is a module; an order imports and calls the parts of its lines, a customer its orders,
a nation its customers, a region its nations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.functions import paths as P
from ripplework.functions.text import join_limited, short_symbol
from ripplework.operators import graph as G
from ripplework.operators import impact as I
from ripplework.operators import resolve as R
from ripplework.operators.intervals import innermost_interval, levels_for
from ripplework.plans.registry import query, table
from ripplework.session import cut_lineage



def _repo() -> Column:
    return F.lit("trade").alias("repo")


URL = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _key(prefix: str, name: str, suffix: str = ".py") -> Column:
    return F.concat(F.lit(prefix), F.col(name).cast("string"), F.lit(suffix))


def _url_path() -> Column:
    return F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")


# ----------------------------------------------------------------------------- predicates


@query("ignore_filter", f"""
SELECT page_id, {URL} AS path FROM pages
WHERE NOT (ends_with(lower({URL}), '.html') OR {URL} = 'spam-farm.example.org' OR starts_with({URL}, 'spam-farm.example.org/'))""")
def ignore_filter(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", _url_path().alias("path"))
    return pages.where(~P.is_ignored("path", ("*.HTML", "spam-farm.example.org")))


@query("secret_filter", """
SELECT doc_id, regexp_matches(lower(source || '/' || lang || CASE WHEN lang = 'de' THEN '/key.PEM' WHEN lang = 'fr' THEN '/.env'
  WHEN lang = 'es' THEN '/environment.py' ELSE '/id_rsa' END), '(^|/)(\\.env|\\.env\\.[^/]*|[^/]*\\.pem|id_rsa|\\.ssh|\\.aws)(/|$)') AS secret
FROM documents""")
def secret_filter(spark, folder):
    leaf = F.when(F.col("lang") == "de", "/key.PEM").when(F.col("lang") == "fr", "/.env").when(
        F.col("lang") == "es", "/environment.py").otherwise("/id_rsa")
    return table(spark, folder, "documents").select(
        "doc_id", P.is_secret(F.concat("source", F.lit("/"), "lang", leaf)).alias("secret"))


CLASSIFY_PATH = """
CASE p_type WHEN 'ECONOMY' THEN 'src/' || p_name || '_test.py' WHEN 'SMALL' THEN 'latest/p' || p_partkey || '.ini'
  WHEN 'MEDIUM' THEN 'tests/' || p_brand || '/x.py' WHEN 'PROMO' THEN 'web/' || p_name || '.Spec.ts'
  WHEN 'LARGE' THEN 'pkg/' || p_partkey || '/Cargo.toml' ELSE 'src/p' || p_partkey || '.py' END"""


@query("classify_file", f"""
SELECT p_partkey, {CLASSIFY_PATH} AS path, CASE p_type WHEN 'ECONOMY' THEN 'test' WHEN 'SMALL' THEN 'configuration'
  WHEN 'MEDIUM' THEN 'test' WHEN 'PROMO' THEN 'test' WHEN 'LARGE' THEN 'dependency' END AS category FROM part""")
def classify_file(spark, folder):
    key, kind = F.col("p_partkey").cast("string"), F.col("p_type")
    path = (
        F.when(kind == "ECONOMY", F.concat(F.lit("src/"), "p_name", F.lit("_test.py")))
        .when(kind == "SMALL", F.concat(F.lit("latest/p"), key, F.lit(".ini")))
        .when(kind == "MEDIUM", F.concat(F.lit("tests/"), "p_brand", F.lit("/x.py")))
        .when(kind == "PROMO", F.concat(F.lit("web/"), "p_name", F.lit(".Spec.ts")))
        .when(kind == "LARGE", F.concat(F.lit("pkg/"), key, F.lit("/Cargo.toml")))
        .otherwise(F.concat(F.lit("src/p"), key, F.lit(".py"))))
    return table(spark, folder, "part").select("p_partkey", path.alias("path")).withColumn(
        "category", P.classify_file("path"))


@query("path_fold", """
WITH link AS (
  SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
both_ AS (SELECT page_id, href, 'down' AS way, 'a/b/.' || href AS path FROM link
  UNION ALL SELECT page_id, href, 'up', 'a/b/../..' || '/..' || href || '/./x//../y' FROM link)
SELECT page_id, href, way, array_to_string(list_reduce(list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.')),
    lambda kept, s: CASE WHEN s = '..' AND len(kept) > 0 AND kept[-1] <> '..' THEN kept[:-2] ELSE list_append(kept, s) END, CAST([] AS VARCHAR[])), '/') AS folded
FROM both_""")
def path_fold(spark, folder):
    """Link targets folded below a directory, and the same links climbing out of it; ``..`` with nothing above it stays."""
    links = table(spark, folder, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    ways = F.explode(F.array(
        F.struct(F.lit("down").alias("way"), F.concat(F.lit("a/b/."), "href").alias("path")),
        F.struct(F.lit("up").alias("way"), F.concat(F.lit("a/b/../../.."), "href", F.lit("/./x//../y")).alias("path")))).alias("w")
    return links.select("page_id", "href", ways).select("page_id", "href", "w.way", P.fold_dots("w.path").alias("folded"))


# ----------------------------------------------------------------------------- name index

PAGE_FILES = f"SELECT DISTINCT regexp_replace({URL}, '/$', '') || '.py' AS path FROM pages"
NAMES_SQL = f"""
WITH f AS ({PAGE_FILES}), p AS (SELECT path, string_split(regexp_replace(path, '\\.pyi?$', ''), '/') AS parts FROM f),
n AS (SELECT path, s AS start, array_to_string(parts[s + 1:], '.') AS name
      FROM p, LATERAL (SELECT unnest(range(len(parts))) AS s))
"""


def _page_files(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.regexp_replace(_url_path(), "/$", ""), F.lit(".py"))
    return table(spark, folder, "pages").select(F.lit("site").alias("repo"), path.alias("path")).distinct()


@query("module_names", NAMES_SQL + "SELECT path, CAST(start AS INTEGER) AS start, name FROM n")
def module_names(spark, folder):
    return R.module_names(_page_files(spark, folder)).drop("repo")


@query("module_index", NAMES_SQL + """
SELECT name, path FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY length(path), path) AS r FROM n)
WHERE r = 1""")
def module_index(spark, folder):
    return R.module_index(R.module_names(_page_files(spark, folder))).drop("repo")


PACKAGES_SQL = """
WITH f AS (SELECT 'src/s' || s_suppkey || '/__init__.py' AS path, 's' || s_suppkey AS pkg, s_suppkey AS k, -1 AS part FROM supplier
           UNION ALL SELECT DISTINCT 'src/s' || l_suppkey || '/p' || l_partkey || '.py', 's' || l_suppkey, l_suppkey, l_partkey FROM lineitem)
"""


def _package_files(spark: SparkSession, folder: str) -> DataFrame:
    """A src layout: one package per supplier, one module per part it ships."""
    packages = table(spark, folder, "supplier").select(_repo(), _key("src/s", "s_suppkey", "/__init__.py").alias("path"))
    modules = table(spark, folder, "lineitem").select(
        _repo(), F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string"), F.lit("/p"),
                       F.col("l_partkey").cast("string"), F.lit(".py")).alias("path")).distinct()
    return packages.unionByName(modules)


@query("package_modules", PACKAGES_SQL + """
SELECT path, pkg || CASE WHEN part >= 0 THEN '.p' || part ELSE '' END AS module_name FROM f""")
def package_modules(spark, folder):
    """The shortest importable name: the source root is dropped, the package prefix is not."""
    return R.module_name_of(R.module_names(_package_files(spark, folder))).drop("repo")


@query("import_candidates", """
SELECT l_orderkey, l_linenumber,
  CASE l_returnflag WHEN 'A' THEN 'shop.parts.p' || l_partkey || ',shop.parts'
       WHEN 'N' THEN 'shop.orders.p' || l_partkey || ',shop.orders'
       ELSE 'shop.p' || l_partkey || ',shop' END AS candidates FROM lineitem""")
def import_candidates(spark, folder):
    """Absolute, level-1 and level-2 imports of a part from ``shop.orders.o<key>``."""
    flag = F.col("l_returnflag")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.array_join(R.python_candidates(
            F.when(flag == "A", "shop.parts").otherwise(""), F.concat(F.lit("p"), F.col("l_partkey").cast("string")),
            F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2),
            F.concat(F.lit("shop.orders.o"), F.col("l_orderkey").cast("string")), F.lit(False)), ",").alias("candidates"))


# --------------------------------------------------------------------- import resolution


def _trade_files(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").where("p_size <> 2").select(_repo(), _key("catalog/p", "p_partkey").alias("path"))
    orders = table(spark, folder, "orders").select(_repo(), _key("sales/o", "o_orderkey").alias("path"))
    return parts.unionByName(orders)


def _numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with their place in the order: line numbers repeat, and every row is a statement of its own."""
    from pyspark.sql import Window

    within = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return table(spark, folder, "lineitem").withColumn("nth", F.row_number().over(within))


def _trade_imports(spark: SparkSession, folder: str) -> DataFrame:
    """Each line of an order imports its part by name and its supplier, which is no module."""
    none = F.lit(None).cast("string")
    part = F.struct((2 * F.col("nth")).alias("ordinal"), F.lit("catalog").alias("module"), _key("p", "l_partkey", "").alias("name"),
                    F.col("l_linenumber").alias("line"))
    supplier = F.struct((2 * F.col("nth") + 1).alias("ordinal"), _key("vendor", "l_suppkey", "").alias("module"), none.alias("name"),
                        (F.col("l_linenumber") + 100).alias("line"))
    return _numbered_lines(spark, folder).select(_repo(), _key("sales/o", "l_orderkey").alias("path"), F.explode(F.array(part, supplier)).alias("i")).select(
        "repo", "path", "i.ordinal", "i.module", "i.name", none.alias("alias"), F.lit(0).alias("level"), "i.line")


TRADE_SQL = """
WITH one AS (SELECT l_orderkey, l_linenumber, l_partkey AS part, l_suppkey AS supp FROM lineitem),
gone AS (SELECT p_partkey FROM part WHERE p_size = 2),
imp AS (
  SELECT l_orderkey AS o, l_linenumber AS line, 'catalog' AS module, 'p' || part AS name, part,
         CASE WHEN g.p_partkey IS NULL THEN 'catalog/p' || part || '.py' END AS target
  FROM one LEFT JOIN gone g ON g.p_partkey = part
  UNION ALL SELECT l_orderkey, l_linenumber + 100, 'vendor' || supp, NULL, NULL, NULL FROM one)
"""


def _resolved_trade(spark: SparkSession, folder: str) -> DataFrame:
    return R.resolve_imports(_trade_imports(spark, folder), _trade_files(spark, folder))


@query("import_resolution", TRADE_SQL + """
SELECT 'sales/o' || o || '.py' AS path, CAST(line AS INTEGER) AS line, module, name, target FROM imp""")
def import_resolution(spark, folder):
    return _resolved_trade(spark, folder).select("path", "line", "module", "name", "target")


@query("unresolved_external", TRADE_SQL + """
SELECT 'sales/o' || o || '.py' AS path, CAST(line AS INTEGER) AS line, module FROM imp WHERE target IS NULL AND part IS NULL""")
def unresolved_external(spark, folder):
    """Imports that point outside: unresolved, and no departed part explains them."""
    unresolved = _unresolved(spark, folder)
    return G.external_imports(unresolved, _dangling(spark, folder, unresolved)).select("path", "line", "module")


def _unresolved(spark: SparkSession, folder: str) -> DataFrame:
    """Imports of no module, written once: what explains them is looked up more than once."""
    return cut_lineage(G.unresolved_imports(_resolved_trade(spark, folder)))


def _dangling(spark: SparkSession, folder: str, unresolved: DataFrame) -> DataFrame:
    files = _trade_files(spark, folder)
    departed = table(spark, folder, "part").where("p_size = 2").select(_repo(), _key("catalog/p", "p_partkey").alias("path"))
    then = R.resolve_imports(unresolved, files.unionByName(departed))
    return G.dangling_imports(then, departed)


@query("dangling_imports", TRADE_SQL + """
SELECT DISTINCT 'sales/o' || o || '.py' AS path, 'catalog/p' || part || '.py' AS target, CAST(line AS INTEGER) AS line, module
FROM imp WHERE target IS NULL AND part IS NOT NULL""")
def dangling_imports(spark, folder):
    return _dangling(spark, folder, _unresolved(spark, folder)).drop("repo")


@query("external_modules", TRADE_SQL + "SELECT DISTINCT module FROM imp WHERE target IS NULL AND part IS NULL")
def external_modules(spark, folder):
    unresolved = _unresolved(spark, folder)
    return G.external_modules(G.external_imports(unresolved, _dangling(spark, folder, unresolved))).select("module")


@query("ts_alias_rewrite", """
SELECT p_partkey, '@app/' || lower(p_type) || '/p' || p_partkey AS specifier,
  CASE WHEN p_type = 'PROMO' THEN 'promo/p' || p_partkey ELSE 'src/' || lower(p_type) || '/p' || p_partkey END AS first_base,
  CASE WHEN p_type = 'PROMO' THEN 2 ELSE 1 END AS bases FROM part""")
def ts_alias_rewrite(spark, folder):
    """Two wildcard aliases off a tsconfig; the longer prefix answers first."""
    config = ('{ // aliases\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"], '
              '"@app/promo/*": ["promo/*"],},}, }')
    configs = table(spark, folder, "region").select(
        _repo(), F.lit("tsconfig.json").alias("path"), F.lit(config).alias("content")).distinct()
    specifiers = table(spark, folder, "part").select(
        _repo(), "p_partkey", F.concat(F.lit("@app/"), F.lower("p_type"), F.lit("/p"), F.col("p_partkey").cast("string")).alias("specifier"))
    bases = R.rewritten_specifiers(specifiers, R.alias_table(configs)).groupBy("repo", "specifier").agg(
        F.min_by("base", "rank").alias("first_base"), F.count("*").cast("int").alias("bases"))
    return specifiers.join(bases, ["repo", "specifier"], "left").drop("repo")


@query("ts_resolution", """
SELECT l_orderkey, l_linenumber, CASE l_returnflag
    WHEN 'A' THEN 'web/part/p' || l_partkey || '.ts' WHEN 'N' THEN 'web/kit' || l_suppkey || '/index.tsx' END AS target FROM lineitem""")
def ts_resolution(spark, folder):
    """Relative specifiers to a file and to a directory, and bare ones that stay external."""
    files = table(spark, folder, "part").select(_repo(), _key("web/part/p", "p_partkey", ".ts").alias("path")).unionByName(
        table(spark, folder, "supplier").select(_repo(), _key("web/kit", "s_suppkey", "/index.tsx").alias("path")))
    line = _numbered_lines(spark, folder)
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    module = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("../part/./p"), part)).when(
        F.col("l_returnflag") == "N", F.concat(F.lit("../kit"), supplier)).otherwise("react")
    imports = line.select(
        _repo(), _key("web/page/o", "l_orderkey", ".tsx").alias("path"), F.col("nth").alias("ordinal"),
        module.alias("module"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("alias"),
        F.lit(0).alias("level"), F.col("l_linenumber").alias("line"), "l_orderkey", "l_linenumber")
    return R.resolve_imports(imports, files).select("l_orderkey", "l_linenumber", "target")


FAMILY_SQL = """
SELECT language, s_suppkey, CASE language WHEN 'go' THEN 'pkg' || s_suppkey || '/a.go'
  WHEN 'java' THEN 'src/S' || s_suppkey || '.java' WHEN 'csharp' THEN 'app/S' || s_suppkey || '.cs'
  ELSE 'src/m' || s_suppkey || '/mod.rs' END AS target
FROM supplier, (VALUES ('go'), ('java'), ('csharp'), ('rust')) v(language)"""


def _family_repository(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A package per supplier in Go, Java, C# and Rust, each imported once."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    shapes = F.explode(F.array(*[F.struct(
        F.lit(language).alias("language"), F.concat(F.lit(before), F.col("k"), F.lit(after)).alias("path"),
        F.concat(F.lit(head), F.col("k"), F.lit(tail)).alias("head"), F.concat(F.lit(module), F.col("k"), F.lit(rest)).alias("module"),
    ) for language, before, after, head, tail, module, rest in (
        ("go", "pkg", "/a.go", "package p", "\n", "example.com/m/pkg", ""),
        ("java", "src/S", ".java", "// head\npackage com.s", ";\n", "com.s", ".Store"),
        ("csharp", "app/S", ".cs", "using System;\nnamespace App.S", ";\n", "App.S", ""),
        ("rust", "src/m", "/mod.rs", "pub fn f", "() {}\n", "crate::m", "::login"),
    )])).alias("f")
    listed = s.select("k", shapes).select("k", "f.*")
    root = table(spark, folder, "region").select(
        _repo(), F.lit("go.mod").alias("path"), F.lit("module example.com/m\n").alias("head")).distinct()
    heads = listed.select(_repo(), "path", "head").unionByName(root)
    suffix = F.create_map(*[F.lit(x) for x in ("go", ".go", "java", ".java", "csharp", ".cs", "rust", ".rs")])
    imports = listed.select(
        _repo(), F.concat(F.lit("main/"), "k", F.try_element_at(suffix, F.col("language"))).alias("path"), F.lit(0).alias("ordinal"), "module",
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("alias"), F.lit(0).alias("level"),
        F.lit(1).alias("line"), "language", F.col("k").cast("bigint").alias("s_suppkey"))
    return heads.select("repo", "path"), heads, imports


@query("c_family_resolution", FAMILY_SQL)
def c_family_resolution(spark, folder):
    files, heads, imports = _family_repository(spark, folder)
    tagged = imports.withColumnRenamed("language", "written_in")
    return R.resolve_imports(tagged, files, heads).select(
        F.col("written_in").alias("language"), "s_suppkey", "target")


@query("last_binding_wins", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def last_binding_wins(spark, folder):
    """An event binds its type for its user; the last binding is in effect."""
    events = table(spark, folder, "events")
    imports = events.select(
        F.lit("log").alias("repo"), F.concat(F.lit("u"), "user_id").alias("path"), F.struct("ts", "event_id").alias("ordinal"),
        F.lit("events").alias("module"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("alias"),
        "user_id", "event_id", "value")
    return R.bound_imports(imports).select(
        "import.user_id", F.col("bound").alias("event_type"), "import.event_id", "import.value")


# ------------------------------------------------------------------------------- intervals


@query("innermost_interval", """
WITH i AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + CAST(floor(value * 60) AS BIGINT) AS e
           FROM events WHERE event_type = 'purchase'),
p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events WHERE event_type = 'click')
SELECT p.event_id, first(i.event_id ORDER BY i.e - i.s, i.event_id) AS purchase FROM p
LEFT JOIN i ON i.user_id = p.user_id AND p.t BETWEEN i.s AND i.e GROUP BY p.event_id""")
def nearest_purchase(spark, folder):
    """Each click inside the shortest purchase interval of its user."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    events = table(spark, folder, "events").withColumn("s", second)
    points = events.where("event_type = 'click'").select("event_id", "user_id", F.col("s").alias("t"))
    intervals = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase"), "s", (F.col("s") + F.floor(F.col("value") * 60).cast("bigint")).alias("e"))
    return innermost_interval(
        points, intervals, keys=["user_id"], point_id=["user_id", "event_id"], at="t", start="s", end="e",
        order=["purchase"], carry=["purchase"], levels=levels_for(1 << 31)).select("event_id", "purchase")


# ----------------------------------------------------------------------------- call ladder

LADDER_SQL = """
WITH one AS (SELECT l_orderkey, l_linenumber, struct_pack(p := l_partkey, f := l_returnflag, q := l_linestatus) AS l FROM lineitem)
SELECT l_orderkey, l_linenumber,
  CASE l.f WHEN 'A' THEN 'catalog/p' || l.p || '.py' ELSE 'sales/o' || l_orderkey || '.py' END AS target,
  CASE l.f WHEN 'A' THEN CASE WHEN l.q = 'F' THEN 'price' ELSE 'gone' END WHEN 'N' THEN 'total' ELSE 'Order.check' END AS names,
  CASE l.f WHEN 'A' THEN CASE WHEN l.q = 'F' THEN 'confirmed' ELSE 'inferred' END ELSE 'high_confidence' END AS confidence
FROM one"""


@query("call_resolution_ladder", LADDER_SQL)
def call_resolution_ladder(spark, folder):
    """Calls through an import, to a local function and through ``self``."""
    line = _numbered_lines(spark, folder)
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    base = line.select(_repo(), _key("sales/o", "l_orderkey").alias("path"), F.col("nth").alias("ordinal"),
                       F.col("l_linenumber").alias("line"), "l_orderkey", "l_linenumber", part.alias("part"),
                       flag.alias("flag"), status.alias("status"))
    calls = base.select("repo", "path", "ordinal", "line", F.when(
        F.col("flag") == "A", F.concat("part", F.when(F.col("status") == "F", ".price").otherwise(".gone")))
        .when(F.col("flag") == "N", "total").otherwise("self.check").alias("name"))
    resolved = base.where("flag = 'A'").select(
        "repo", "path", "ordinal", F.lit("catalog").alias("module"), F.col("part").alias("name"),
        F.lit(None).cast("string").alias("alias"), F.lit(0).alias("level"), "line",
        F.concat(F.lit("catalog/"), "part", F.lit(".py")).alias("target"))
    part_symbols = table(spark, folder, "part").select(
        _repo(), _key("catalog/p", "p_partkey").alias("path"), F.lit(0).alias("ordinal"), F.lit("price").alias("qualified_name"),
        F.lit("price").alias("name"), F.lit(None).cast("string").alias("parent"))
    own = F.explode(F.array(*[F.struct(F.lit(n).alias("ordinal"), F.lit(q).alias("qualified_name"), F.lit(s).alias("name"),
                                       F.lit(p).cast("string").alias("parent"))
                              for n, q, s, p in ((0, "total", "total", None), (1, "Order", "Order", None), (2, "Order.check", "check", "Order"))]))
    order_symbols = table(spark, folder, "orders").select(_repo(), _key("sales/o", "o_orderkey").alias("path"), own.alias("s")).select(
        "repo", "path", "s.*")
    answered = R.resolve_calls(calls, resolved, part_symbols.unionByName(order_symbols))
    return answered.select(
        F.regexp_extract("path", "o(\\d+)", 1).cast("bigint").alias("l_orderkey"), F.col("line").alias("l_linenumber"),
        "target", F.array_join("names", ",").alias("names"), "confidence")


@query("sibling_lookup", """
WITH f AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey || '.go' AS path, 'r' || n_regionkey AS a,
             'r' || n_regionkey || '/n' || n_nationkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT f.path, CAST(g.k AS BIGINT) AS siblings, g.first AS first_sibling FROM f
JOIN (SELECT b, count(*) AS k, min(path) AS first FROM f GROUP BY b) g USING (b)""")
def sibling_lookup(spark, folder):
    """Customers as Go files in a directory per nation."""
    files = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        _repo(), F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit("/c"), "c_custkey", F.lit(".go")).alias("path"))
    return R.siblings(files).drop("repo")


# ---------------------------------------------------------------------------------- graph


def _line_edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        _repo(), _key("sales/o", "l_orderkey").alias("source_path"), _key("catalog/p", "l_partkey").alias("target_path"),
        F.lit("catalog").alias("module"), F.col("l_linenumber").alias("line"), F.col("l_linenumber").alias("ordinal"), "l_shipdate")


@query("most_imported", """
SELECT 'catalog/p' || l_partkey || '.py' AS target_path, count(*) AS imports FROM lineitem GROUP BY 1
ORDER BY imports DESC, target_path LIMIT 10""")
def most_imported(spark, folder):
    return G.most_imported(_line_edges(spark, folder)).drop("repo")


@query("importers_map", """
SELECT 'catalog/p' || l_partkey || '.py' AS target_path, 'sales/o' || l_orderkey || '.py' AS source_path,
  count(*) AS statements, min(l_linenumber) AS first_line FROM lineitem GROUP BY ALL""")
def importers_map(spark, folder):
    return G.importers_map(_line_edges(spark, folder)).drop("repo")


@query("graph_edge_diff", """
WITH e AS (SELECT 'p' || l_partkey AS s, 's' || l_suppkey AS t, l_linenumber AS line, year(l_shipdate) AS y, l_orderkey FROM lineitem),
f AS (SELECT s, t, y < 2000 AS old, first(line ORDER BY l_orderkey, line) AS line FROM e GROUP BY s, t, y < 2000)
SELECT coalesce(a.s, b.s) AS source_path, coalesce(a.t, b.t) AS target_path, coalesce(a.line, b.line) AS line,
  CASE WHEN a.s IS NULL THEN 'import_removed' ELSE 'import_added' END AS change
FROM (SELECT * FROM f WHERE old) b FULL JOIN (SELECT * FROM f WHERE NOT old) a ON a.s = b.s AND a.t = b.t
WHERE a.s IS NULL OR b.s IS NULL""")
def graph_edge_diff(spark, folder):
    """Part-to-supplier relationships before and after the turn of the century."""
    edges = table(spark, folder, "lineitem").select(
        _repo(), F.concat(F.lit("p"), "l_partkey").alias("source_path"), F.concat(F.lit("s"), "l_suppkey").alias("target_path"),
        F.lit("vendor").alias("module"), F.col("l_linenumber").alias("line"), F.struct("l_orderkey", "l_linenumber").alias("ordinal"),
        (F.year("l_shipdate") < 2000).alias("old"))
    return G.graph_diff(G.first_edges(edges.where("old")), G.first_edges(edges.where("not old"))).select(
        "source_path", "target_path", "line", "change")


@query("graph_staleness", """
SELECT c_mktsegment AS repo, bool_or(c_acctbal < 0 OR c_nationkey = 3) AS stale FROM customer GROUP BY 1""")
def graph_staleness(spark, folder):
    """Overdrawn customers changed their imports, those of one nation are new files."""
    changed = table(spark, folder, "customer").select(
        F.col("c_mktsegment").alias("repo"), F.when(F.col("c_nationkey") == 3, "added").otherwise("modified").alias("status"),
        F.lit(None).cast("string").alias("original_path"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("imports_added"),
        F.lit(0).alias("imports_removed"))
    return G.graph_is_stale(changed)


@query("limitations_cap", """
WITH t AS (SELECT DISTINCT p_brand AS repo, p_name || ':' || p_size || ' calls getattr, and what that runs is only known at run time' AS text,
             p_name AS path, p_size AS line FROM part),
r AS (SELECT repo, text, row_number() OVER (PARTITION BY repo ORDER BY path, line, text) AS rank, count(*) OVER (PARTITION BY repo) AS n FROM t)
SELECT repo, CAST(rank AS INTEGER) AS rank, text FROM r WHERE rank <= 20
UNION ALL SELECT DISTINCT repo, 21, 'and ' || (n - 20) || ' further limitation(s)' FROM r WHERE n > 20""")
def limitations_cap(spark, folder):
    """Each part as a dynamic call in its brand's repository; twenty are kept, the rest counted."""
    calls = table(spark, folder, "part").select(
        F.col("p_brand").alias("repo"), F.col("p_name").alias("path"), F.col("p_size").alias("line"),
        F.lit("obj.getattr").alias("name"), F.col("p_size").alias("ordinal"))
    imports = calls.where("false").withColumn("name", F.lit("*"))
    found = G.dynamic_limitations(imports, calls, calls.select("repo", "path"))
    return G.capped_limitations(found, ["path", "part", "ordinal"])


# --------------------------------------------------------------------------- impact walk


def _trade_symbol_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of sizes 1 to 4 changed: declaration, removal, body, and a new symbol."""
    size = F.col("p_size")
    return table(spark, folder, "part").where(size <= 4).select(
        _repo(), _key("catalog/p", "p_partkey").alias("path"), F.lit("price").alias("qualified_name"),
        F.when(size == 1, "signature_changed").when(size == 2, "removed").when(size == 3, "body_changed").otherwise("added").alias("change"),
        size.alias("line_start"), F.col("p_name").alias("detail"))


def _trade_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Who calls whom, already resolved: one row per order line, order, customer and nation."""
    def called(frame: DataFrame, source: Column, target: Column, line: Column, ordinal: Column, call: Column,
               names: Column, caller: Column) -> DataFrame:
        return frame.select(
            _repo(), source.alias("path"), line.cast("int").alias("line"), call.alias("name"), ordinal.cast("int").alias("ordinal"),
            target.alias("target"), names.alias("names"), F.lit("confirmed").alias("confidence"), caller.alias("caller"))

    settle = F.array(F.lit("settle_A"), F.lit("settle_N"), F.lit("settle_R"))
    lines = called(
        table(spark, folder, "lineitem"), _key("sales/o", "l_orderkey"), _key("catalog/p", "l_partkey"), F.col("l_linenumber"),
        F.col("l_suppkey"), F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".price")), F.array(F.lit("price")),
        F.concat(F.lit("settle_"), "l_returnflag"))
    orders = called(
        table(spark, folder, "orders"), _key("crm/c", "o_custkey"), _key("sales/o", "o_orderkey"), F.col("o_orderkey"), F.lit(0),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".settle")), settle, F.lit("history"))
    customers = called(
        table(spark, folder, "customer"), _key("geo/n", "c_nationkey"), _key("crm/c", "c_custkey"), F.col("c_custkey"), F.lit(0),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".history")), F.array(F.lit("history")), F.lit(None).cast("string"))
    nations = called(
        table(spark, folder, "nation"), _key("geo/r", "n_regionkey"), _key("geo/n", "n_nationkey"), F.col("n_nationkey"), F.lit(0),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".all")), F.array(F.lit("all")), F.lit("roll_up"))
    return lines.unionByName(orders).unionByName(customers).unionByName(nations)


def trade_walk(spark: SparkSession, folder: str, max_depth: int = 5) -> I.Walk:
    changes = _trade_symbol_changes(spark, folder)
    files = changes.select("repo", "path", F.when(F.col("change") == "removed", "deleted").otherwise("modified").alias("status"),
                           F.lit(True).alias("analysed"))
    no_imports = spark.createDataFrame([], "repo string, path string, added bigint, removed bigint")
    direct = I.direct_nodes(files, changes, no_imports)
    calls = _trade_calls(spark, folder)
    edges = calls.select("repo", F.col("path").alias("source_path"), F.col("target").alias("target_path"))
    return I.walk(direct, I.seeds_of(changes), I.walkable_calls(calls), max_depth, edges)


# The same walk in SQL: five layers, each ranked in the order its arrivals are met.
WALK_SQL = """
WITH direct AS (
  SELECT 'catalog/p' || p_partkey || '.py' AS path, 'price' AS symbol, p_size, p_name FROM part WHERE p_size <= 4),
seed AS (
  SELECT path, symbol, CASE p_size WHEN 1 THEN 'indirect' WHEN 2 THEN 'indirect' ELSE 'potential' END AS category,
    CASE p_size WHEN 1 THEN 'signature_changed' WHEN 2 THEN 'symbol_removed' ELSE 'body_changed' END AS reason,
    row_number() OVER (ORDER BY path, p_size) AS ord FROM direct WHERE p_size <= 3),
a1 AS (
  SELECT 'sales/o' || l_orderkey || '.py' AS path, 'settle_' || l_returnflag AS symbol, s.category, s.reason,
    s.path || '>sales/o' || l_orderkey || '.py' AS chain, s.ord AS o1, 'sales/o' || l_orderkey || '.py' AS o2,
    l_linenumber AS o3, 'p' || l_partkey || '.price' AS o4, l_suppkey AS o5
  FROM lineitem JOIN seed s ON s.path = 'catalog/p' || l_partkey || '.py'),
n1 AS (SELECT *, row_number() OVER (ORDER BY o1, o2, o3, o4, o5) AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY o1, o2, o3, o4, o5) AS r FROM a1) WHERE r = 1),
a2 AS (
  SELECT 'crm/c' || o_custkey || '.py' AS path, 'history' AS symbol, n.chain || '>crm/c' || o_custkey || '.py' AS chain,
    n.ord AS o1, o_orderkey AS o3 FROM orders JOIN n1 n ON n.path = 'sales/o' || o_orderkey || '.py'),
n2 AS (SELECT *, row_number() OVER (ORDER BY o1, path, o3) AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY o1, o3) AS r FROM a2) WHERE r = 1),
a3 AS (
  SELECT 'geo/n' || c_nationkey || '.py' AS path, CAST(NULL AS VARCHAR) AS symbol, n.chain || '>geo/n' || c_nationkey || '.py' AS chain,
    n.ord AS o1, c_custkey AS o3 FROM customer JOIN n2 n ON n.path = 'crm/c' || c_custkey || '.py'),
n3 AS (SELECT *, row_number() OVER (ORDER BY o1, path, o3) AS ord FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY o1, o3) AS r FROM a3) WHERE r = 1),
a4 AS (
  SELECT 'geo/r' || n_regionkey || '.py' AS path, 'roll_up' AS symbol, n.chain || '>geo/r' || n_regionkey || '.py' AS chain,
    n.ord AS o1, n_nationkey AS o3 FROM nation JOIN n3 n ON n.path = 'geo/n' || n_nationkey || '.py'),
n4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY o1, o3) AS r FROM a4) WHERE r = 1),
node AS (
  SELECT path, symbol, 'direct' AS category, 0 AS distance,
    CASE p_size WHEN 1 THEN 'symbol_signature_changed' WHEN 2 THEN 'file_deleted' WHEN 3 THEN 'symbol_body_changed' ELSE 'symbol_added' END AS reason,
    path AS chain FROM direct
  UNION ALL SELECT path, symbol, category, 1, reason, chain FROM n1
  UNION ALL SELECT path, symbol, 'potential', 2, 'indirect_dependency', chain FROM n2
  UNION ALL SELECT path, symbol, 'potential', 3, 'indirect_dependency', chain FROM n3
  UNION ALL SELECT path, symbol, 'potential', 4, 'indirect_dependency', chain FROM n4),
reach AS (
  SELECT path, symbol, reason, min(category) AS category, count(*) AS arrivals, 1 AS distance FROM (
    SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY o1, o2, o3, o4, o5) AS r FROM a1) WHERE r > 1 GROUP BY path, symbol, reason
  UNION ALL SELECT path, symbol, 'indirect_dependency', 'potential', count(*) - 1, 2 FROM a2 GROUP BY path, symbol HAVING count(*) > 1
  UNION ALL SELECT path, symbol, 'indirect_dependency', 'potential', count(*) - 1, 3 FROM a3 GROUP BY path, symbol HAVING count(*) > 1
  UNION ALL SELECT path, symbol, 'indirect_dependency', 'potential', count(*) - 1, 4 FROM a4 GROUP BY path, symbol HAVING count(*) > 1),
review AS (
  SELECT n.* FROM node n WHERE n.reason IN ('dangling_import','file_deleted','signature_changed','symbol_removed','symbol_signature_changed')
    OR EXISTS (SELECT 1 FROM reach r WHERE r.path = n.path AND r.symbol IS NOT DISTINCT FROM n.symbol
               AND r.reason IN ('dangling_import','file_deleted','signature_changed','symbol_removed','symbol_signature_changed')))
"""


@query("impact_rings", WALK_SQL + "SELECT path, symbol, category, 'confirmed' AS confidence, distance, reason, chain FROM node")
def impact_rings(spark, folder):
    return trade_walk(spark, folder).nodes.select(
        "path", "symbol", "category", "confidence", "distance", "reason", F.array_join("chain", ">").alias("chain"))


@query("reaches_merge", WALK_SQL + "SELECT path, symbol, reason, category, distance, CAST(arrivals AS BIGINT) AS arrivals FROM reach")
def reaches_merge(spark, folder):
    return trade_walk(spark, folder).reaches.select("path", "symbol", "reason", "category", "distance", "arrivals")


@query("impact_attenuation", WALK_SQL + """
SELECT distance, category, reason, count(*) AS nodes FROM node GROUP BY ALL""")
def impact_attenuation(spark, folder):
    return trade_walk(spark, folder).nodes.groupBy("distance", "category", "reason").agg(F.count("*").alias("nodes"))


@query("requiring_review", WALK_SQL + "SELECT path, symbol, reason FROM review")
def requiring_review(spark, folder):
    found = trade_walk(spark, folder)
    return I.requiring_review(found.nodes, found.reaches).select("path", "symbol", "reason")


@query("impact_totals", WALK_SQL + """
SELECT count(*) AS nodes, count(DISTINCT path) AS files, count(*) FILTER (category = 'direct') AS direct,
  count(*) FILTER (category = 'indirect') AS indirect, count(*) FILTER (category = 'potential') AS potential,
  (SELECT count(*) FROM review) AS requiring_review FROM node""")
def impact_totals(spark, folder):
    found = trade_walk(spark, folder)
    return I.totals(found.nodes, I.requiring_review(found.nodes, found.reaches)).select(
        "nodes", "files", "direct", "indirect", "potential", "requiring_review")


@query("deepest_distance", WALK_SQL + """
SELECT max(distance) AS max_depth FROM (SELECT distance FROM node UNION ALL SELECT distance FROM reach)""")
def deepest_distance(spark, folder):
    found = trade_walk(spark, folder)
    return I.deepest(found.nodes, found.reaches).select("max_depth")


@query("impact_truncated", WALK_SQL + """
SELECT TRUE AS truncated, count(*) AS nodes FROM node WHERE distance <= 2""")
def impact_truncated(spark, folder):
    """Two rings only: the walk says that it stopped."""
    found = trade_walk(spark, folder, max_depth=2)
    return found.nodes.groupBy("repo").agg(F.count("*").alias("nodes")).join(found.truncated, "repo").select("truncated", "nodes")


@query("impact_preview", WALK_SQL + """
, p AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY distance, path, coalesce(symbol, '')) AS rank,
          count(*) OVER (PARTITION BY category) AS k FROM node)
SELECT category, path, symbol, CAST(rank AS INTEGER) AS rank, greatest(k - 15, 0) AS more FROM p WHERE rank <= 15""")
def impact_preview(spark, folder):
    return I.preview(trade_walk(spark, folder).nodes).select(
        "category", "path", "symbol", "rank", F.col("more").cast("bigint").alias("more"))


@query("evidence_counts", WALK_SQL + """
SELECT path, symbol, CAST(distance + 1 AS BIGINT) AS entries FROM node WHERE distance > 0""")
def evidence_counts(spark, folder):
    """A node's own evidence grows by one call per ring."""
    found = trade_walk(spark, folder)
    return found.evidence.where("reach_reason is null").groupBy("path", "symbol").agg(
        F.count("*").alias("entries"), F.max("position.position.distance").alias("d")).where("d > 0").drop("d")


@query("impact_generic_graph", """
WITH RECURSIVE step AS (
  SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS called
  FROM lineitem),
edge AS (SELECT DISTINCT l_partkey AS caller, called FROM step WHERE called IS NOT NULL AND called <> l_partkey),
w(part, d) AS (
  SELECT p_partkey, 0 FROM part WHERE p_size = 1
  UNION SELECT e.caller, w.d + 1 FROM w JOIN edge e ON e.called = w.part WHERE w.d < 3)
SELECT 'catalog/p' || part || '.py' AS path, min(d) AS distance FROM w GROUP BY part""")
def impact_generic_graph(spark, folder):
    """A part calls the next part of the same order; cycles and all, three rings."""
    from pyspark.sql import Window
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(line).alias("called"),
    ).where("called is not null and called <> caller")
    calls = steps.groupBy("caller", "called").agg(F.min("l_linenumber").alias("line")).select(
        _repo(), _key("catalog/p", "caller").alias("path"), "line", _key("p", "called", ".price").alias("name"), F.lit(0).alias("ordinal"),
        _key("catalog/p", "called").alias("target"), F.array(F.lit("price")).alias("names"), F.lit("confirmed").alias("confidence"),
        F.lit("price").alias("caller"))
    changes = table(spark, folder, "part").where("p_size = 1").select(
        _repo(), _key("catalog/p", "p_partkey").alias("path"), F.lit("price").alias("qualified_name"),
        F.lit("signature_changed").alias("change"), F.lit(1).alias("line_start"), F.lit("").alias("detail"))
    files = changes.select("repo", "path", F.lit("modified").alias("status"), F.lit(True).alias("analysed"))
    direct = I.direct_nodes(files, changes, spark.createDataFrame([], "repo string, path string, added bigint, removed bigint"))
    edges = calls.select("repo", F.col("path").alias("source_path"), F.col("target").alias("target_path"))
    return I.walk(direct, I.seeds_of(changes), I.walkable_calls(calls, edges), 3).nodes.select("path", "distance")


@query("short_symbols", """
SELECT p_partkey, 'catalog.' || p_type || '.' || p_name AS qualified, p_name AS short FROM part""")
def short_symbols(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.concat_ws(".", F.lit("catalog"), "p_type", "p_name").alias("qualified")).withColumn(
        "short", short_symbol("qualified"))


@query("joined_clauses", """
SELECT l_orderkey, CASE WHEN count(*) > 2 THEN array_to_string((list('p' || l_partkey ORDER BY l_linenumber, l_partkey))[1:2], ' · ') || ' · +' || (count(*) - 2) || ' more'
  ELSE array_to_string(list('p' || l_partkey ORDER BY l_linenumber, l_partkey), ' · ') END AS parts FROM lineitem GROUP BY l_orderkey""")
def joined_clauses(spark, folder):
    """The lines of an order in at most two clauses; an order has a handful of lines."""
    parts = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
        lambda l: F.concat(F.lit("p"), l["l_partkey"].cast("string"))).alias("parts"))
    return parts.select("l_orderkey", join_limited(F.col("parts")).alias("parts"))
