"""Offers, pairing, rules, screens and de-duplication on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenfunnel.functions import scalars as fn
from screenfunnel.operators import dedupe, expansion, offers, order, pairing, rules, screen
from screenfunnel.operators.profile import stage_counters
from screenfunnel.operators.rules import Limit
from screenfunnel.operators.screen import Alert
from screenfunnel.plans.library import LibraryPlan, run_library
from screenfunnel.plans.library import library_counts as counts_of
from screenfunnel.queries.base import query, settle, table
from screenfunnel.session import scratch_path

# --- offers -----------------------------------------------------------------------------------

OFFERS_SQL = """
    packs AS (
      SELECT l_partkey AS code, l_extendedprice AS price,
             CASE l_returnflag WHEN 'A' THEN l_quantity * 1000.0 WHEN 'R' THEN l_quantity / 1000.0
                  ELSE l_quantity END AS amount,
             CASE l_returnflag WHEN 'A' THEN 'mg' WHEN 'R' THEN 'kg' ELSE 'g' END AS measure
      FROM lineitem),
    offers AS (
      SELECT code, price, price / (CASE measure WHEN 'mg' THEN amount / 1000.0 WHEN 'g' THEN amount
                                                ELSE amount * 1000.0 END) AS price_per_gram
      FROM packs),
    best AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY code ORDER BY price_per_gram, price) AS rn
        FROM offers WHERE price <= 60000) WHERE rn = 1 AND price_per_gram <= 500)
"""


def lineitem_offers(spark: SparkSession, sf: str) -> DataFrame:
    """Each line item as a pack of a part, in milligrams, grams or kilograms."""
    li = table(spark, sf, "lineitem", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    unit = F.when(F.col("l_returnflag") == "A", "mg").when(F.col("l_returnflag") == "R", "kg").otherwise("g")
    amount = (
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * 1000.0)
        .when(F.col("l_returnflag") == "R", F.col("l_quantity") / 1000.0)
        .otherwise(F.col("l_quantity"))
    )
    packs = li.select(
        F.col("l_partkey").alias("code"), F.col("l_extendedprice").alias("price"), amount.alias("amount"), unit.alias("measure")
    )
    return packs.withColumn("price_per_gram", fn.price_per_gram("price", "amount", "measure"))


def best_offers(spark: SparkSession, sf: str) -> DataFrame:
    return offers.best_offer(lineitem_offers(spark, sf), order="price", max_unit=500.0, max_pack=60000.0)


@query(
    "best_offer",
    f"WITH {OFFERS_SQL} SELECT code, price, floor((price_per_gram) * 1e6 + 0.5001) / 1e6 AS price_per_gram FROM best",
)
def best_offer(spark: SparkSession, sf: str) -> DataFrame:
    return best_offers(spark, sf).select("code", "price", settle("price_per_gram", 6).alias("price_per_gram"))


@query(
    "priced_parts",
    f"""WITH {OFFERS_SQL}
    SELECT p_partkey, floor((price_per_gram) * 1e6 + 0.5001) / 1e6 AS "PriceG", floor((price_per_gram * p_size) * 1e4 + 0.5001) / 1e4 AS "PriceMol"
    FROM part JOIN best ON p_partkey = code WHERE price_per_gram > 0""",
)
def priced_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part", "p_partkey", "p_size")
    priced = offers.attach_price(part, best_offers(spark, sf), id_col="p_partkey", weight="p_size")
    return priced.select("p_partkey", settle("PriceG", 6).alias("PriceG"), settle("PriceMol", 4).alias("PriceMol"))


@query("priced_ids", f"WITH {OFFERS_SQL} SELECT DISTINCT p_partkey FROM part JOIN best ON p_partkey = code")
def priced_ids(spark: SparkSession, sf: str) -> DataFrame:
    return offers.priced_ids(table(spark, sf, "part"), best_offers(spark, sf), "p_partkey")


@query("valid_price", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def valid_price(spark: SparkSession, sf: str) -> DataFrame:
    return rules.valid_price(table(spark, sf, "supplier", "s_suppkey", "s_acctbal"), "s_acctbal")


# --- pairing ----------------------------------------------------------------------------------

PAIR_CAP = 1500.0


def parts_and_suppliers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part", "p_partkey", "p_retailprice")
    supplier = rules.valid_price(table(spark, sf, "supplier", "s_suppkey", "s_acctbal"), "s_acctbal")
    return part, supplier


@query(
    "budget_pairs",
    """SELECT 'A' || p_partkey || 'C' || s_suppkey AS "ID", p_partkey, s_suppkey,
              floor((p_retailprice + s_acctbal) * 1e4 + 0.5001) / 1e4 AS "PriceMol"
       FROM part JOIN supplier ON s_acctbal > 0 AND p_retailprice + s_acctbal <= 1500""",
)
def budget_pairs(spark: SparkSession, sf: str) -> DataFrame:
    part, supplier = parts_and_suppliers(spark, sf)
    # the parts of a name are made once per row of a side, not once per pair
    part = part.withColumn("_a", F.concat(F.lit("A"), "p_partkey"))
    supplier = supplier.withColumn("_c", F.concat(F.lit("C"), "s_suppkey"))
    pairs = pairing.pair_within_budget(part, supplier, PAIR_CAP, "p_partkey", "p_retailprice", "s_suppkey", "s_acctbal")
    return pairs.select(F.concat("_a", "_c").alias("ID"), "p_partkey", "s_suppkey", settle("PriceMol", 4).alias("PriceMol"))


@query(
    "budget_pairs_probe",
    """SELECT c_custkey, p_partkey, floor((c_acctbal + p_retailprice) * 1e4 + 0.5001) / 1e4 AS total
       FROM customer JOIN part ON c_acctbal > 0 AND p_retailprice <= 1000 - c_acctbal""",
)
def budget_pairs_probe(spark: SparkSession, sf: str) -> DataFrame:
    customer = rules.valid_price(table(spark, sf, "customer", "c_custkey", "c_acctbal"), "c_acctbal")
    part = table(spark, sf, "part", "p_partkey", "p_retailprice")
    pairs = pairing.pair_within_budget(
        customer, part, 1000.0, "c_custkey", "c_acctbal", "p_partkey", "p_retailprice", form="probe", out="total"
    )
    return pairs.select("c_custkey", "p_partkey", settle("total", 4).alias("total"))


@query(
    "budget_pairs_preflight",
    """SELECT count(*) AS pairs_total,
              count(*) FILTER (WHERE s_acctbal <= 1500 - p_retailprice) AS pairs_affordable
       FROM part CROSS JOIN supplier WHERE s_acctbal > 0""",
)
def budget_pairs_preflight(spark: SparkSession, sf: str) -> DataFrame:
    part, supplier = parts_and_suppliers(spark, sf)
    counts = pairing.pairing_preflight(part, supplier, PAIR_CAP, "p_retailprice", "s_acctbal")
    return counts.select(*[F.col(c).cast("long").alias(c) for c in counts.columns])


@query(
    "reagent_map",
    """SELECT 'A' || p_partkey || 'S' AS "ID", upper(p_name) AS "SMILES", floor((p_retailprice + 10) * 1e4 + 0.5001) / 1e4 AS "PriceMol"
       FROM part WHERE p_retailprice + 10 <= 950""",
)
def reagent_map(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(
        F.concat(F.lit("A"), "p_partkey").alias("ID"), F.col("p_name").alias("SMILES"), F.col("p_retailprice").alias("PriceMol")
    )
    made = pairing.map_with_reagent(part, 10.0, 950.0, lambda s: F.array(F.upper(s)))
    return made.withColumn("PriceMol", settle("PriceMol", 4))


EXPANSION_SQL = """
    WITH r AS (SELECT p_partkey, s_suppkey, string_split(p_type, ' ') AS words, substr(s_name, 10) AS tail, p_retailprice + s_acctbal AS price
      FROM part JOIN supplier ON s_acctbal > 0 AND p_retailprice + s_acctbal <= 1500),
    m AS (SELECT *, CASE WHEN tail NOT LIKE '%7' AND len(words) = 3 THEN list_filter(list_transform(words, lambda w:
      CASE WHEN length(w) = 5 THEN NULL ELSE substr(w, 1, 1) || tail END), lambda p: p IS NULL OR substr(p, 1, 1) <> 'P') END AS made FROM r),
    d AS (SELECT *, list_distinct(list_filter(made, lambda p: p IS NOT NULL)) AS products FROM m)
"""


def initials(words: str, name: str) -> list[str | None]:
    """Up to three products of a part and a supplier: each word's first letter with the end of the name. Parts of other
    than three words and names that end in 7 cannot be read; words of five letters make none, and P is no product."""
    parts, tail = words.split(" "), name[9:]
    if tail.endswith("7") or len(parts) != 3:
        raise ValueError(words)
    return [None if len(w) == 5 else w[0] + tail for w in parts if len(w) == 5 or w[0] != "P"]


def products_of_types(spark: SparkSession, sf: str, make) -> DataFrame:
    part = table(spark, sf, "part", "p_partkey", "p_type", "p_retailprice")
    supplier = rules.valid_price(table(spark, sf, "supplier", "s_suppkey", "s_name", "s_acctbal"), "s_acctbal")
    sides = ("p_partkey", "p_retailprice", "p_type"), ("s_suppkey", "s_acctbal", "s_name")
    return pairing.pair_products(part, supplier, PAIR_CAP, *sides, make)


@query("pair_products", f"{EXPANSION_SQL} SELECT p_partkey, s_suppkey, unnest(products) AS product, floor(price * 1e4 + 0.5001) / 1e4 AS total FROM d")
def pair_products(spark: SparkSession, sf: str) -> DataFrame:
    product = expansion.arrow_products(initials)(F.col("p_type"), F.col("s_name"))
    made = products_of_types(spark, sf, lambda texts: expansion.expand(texts, product, "product"))
    return made.select("p_partkey", "s_suppkey", "product", settle("PriceMol", 4).alias("total"))


@query("pair_products_lateral", f"{EXPANSION_SQL} SELECT p_partkey, s_suppkey, unnest(products) AS product FROM d")
def pair_products_lateral(spark: SparkSession, sf: str) -> DataFrame:
    products = expansion.product_table(initials)
    made = products_of_types(spark, sf, lambda texts: expansion.expand_lateral(texts, products, ["p_type", "s_name"], "product"))
    return made.select("p_partkey", "s_suppkey", "product")


FUNNEL_SQL = f"""
    WITH {OFFERS_SQL},
    blocks AS (
      SELECT 'A' || p_partkey AS id, p_type AS txt, price_per_gram * p_size AS price
      FROM part JOIN best ON p_partkey = code WHERE price_per_gram > 0),
    partners AS (SELECT 'C' || s_suppkey AS id, s_name AS txt, s_acctbal AS price FROM supplier WHERE s_acctbal > 0),
    products AS (
      SELECT b.id || p.id AS id, b.txt || '/' || p.txt AS txt, b.price + p.price AS price
      FROM blocks b JOIN partners p ON b.price + p.price <= 2500),
    cheapest AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY price, id) AS rn FROM products) WHERE rn = 1)
"""


def funnel_products(spark: SparkSession, sf: str) -> DataFrame:
    """Best offer per part → pairs with suppliers within the budget → cheapest per product."""
    part = table(spark, sf, "part", "p_partkey", "p_type", "p_size")
    blocks = offers.attach_price(part, best_offers(spark, sf), id_col="p_partkey", weight="p_size").select(
        F.concat(F.lit("A"), "p_partkey").alias("ID"), F.col("p_type").alias("SMILES"), "PriceMol"
    )
    supplier = rules.valid_price(table(spark, sf, "supplier"), "s_acctbal").select(
        F.concat(F.lit("C"), "s_suppkey").alias("ID"), F.col("s_name").alias("SMILES"), F.col("s_acctbal").alias("PriceMol")
    )
    return pairing.condense_cheapest(blocks, supplier, 2500.0, lambda x, y: F.array(F.concat(x, F.lit("/"), y)))


@query(
    "library_funnel",
    f"""{FUNNEL_SQL}
    SELECT id AS "ID", txt AS "SMILES", floor((price) * 1e4 + 0.5001) / 1e4 AS "PriceMol",
           concat_ws('; ', CASE WHEN price > 1800 THEN 'PriceMol=' || printf('%.2f', price) || '>1800.0' END,
                           CASE WHEN price < 300 THEN 'PriceMol=' || printf('%.2f', price) || '<300.0' END) AS "Rejection"
    FROM cheapest""",
)
def library_funnel(spark: SparkSession, sf: str) -> DataFrame:
    limits = [Limit("PriceMol", ">", 1800.0, 2), Limit("PriceMol", "<", 300.0, 2)]
    accepted, rejected = rules.range_filter(funnel_products(spark, sf), limits)
    both = accepted.withColumn("Rejection", F.lit("")).unionByName(rejected)
    return both.select("ID", "SMILES", settle("PriceMol", 4).alias("PriceMol"), "Rejection")


ROUTE_SQL = """
    WITH a AS (SELECT 'A' || p_partkey AS id, p_type || '/' || p_brand AS txt, p_retailprice AS price FROM part),
    c AS (SELECT 'C' || s_suppkey AS id, s_name AS txt, s_acctbal AS price FROM supplier WHERE s_acctbal > 0),
    n AS (SELECT 'N' || c_custkey AS id, c_mktsegment AS txt, c_acctbal AS price FROM customer WHERE c_acctbal > 0),
    ox AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY price, id) AS rn FROM (
             SELECT a.id || c.id AS id, a.txt || '.' || c.txt AS txt, a.price + c.price AS price
             FROM a JOIN c ON a.price + c.price <= 1200)) WHERE rn = 1 AND price <= 1150),
    im AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY price, id) AS rn FROM (
             SELECT ox.id || n.id AS id, ox.txt || '-' || n.txt AS txt, ox.price + n.price AS price
             FROM ox JOIN n ON n.price <= 1200 - ox.price)) WHERE rn = 1),
    th AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txt ORDER BY price, id) AS rn FROM (
             SELECT id || 'S' AS id, txt || '=S' AS txt, price + 10 AS price FROM ox WHERE price + 10 <= 1200)) WHERE rn = 1),
    products AS (SELECT 'imidazolones' AS family, id, txt, price FROM im UNION ALL SELECT 'thiazolones', id, txt, price FROM th)
    SELECT family, id AS "ID", txt AS "SMILES", floor((price) * 1e4 + 0.5001) / 1e4 AS "PriceMol"
    FROM products WHERE price <= 1190 AND NOT regexp_matches(txt, 'Brand#1/') AND NOT regexp_matches(txt, 'ECONOMY.*7')
"""


def route(spark: SparkSession, sf: str, store: str, counted: bool = True, **settings) -> dict[str, DataFrame]:
    """Parts with suppliers, the cheapest of each product with customers and with a reagent."""

    def blocks(name: str, letter: str, key: str, text, price: str) -> DataFrame:
        priced = rules.valid_price(table(spark, sf, name), price)
        return priced.select(F.concat(F.lit(letter), key).alias("ID"), text.alias("SMILES"), F.col(price).alias("PriceMol"))

    def joined(mark: str):
        return lambda x, y: F.array(F.concat(x, F.lit(mark), y))

    plan = LibraryPlan(
        condensation=joined("."),
        aminolysis=joined("-"),
        sulphur_exchange=lambda x: F.array(F.concat(x, F.lit("=S"))),
        describe=lambda df: df,
        cap=1200.0,
        oxazolone_limits=[Limit("PriceMol", ">", 1150.0, 2)],
        product_limits=[Limit("PriceMol", ">", 1190.0, 2)],
        catalogue=[Alert(1, "First", "brand", "Brand#1/"), Alert(2, "Second(a)", "seven", "ECONOMY.*7")],
        **settings,
    )
    return run_library(
        plan,
        blocks("part", "A", "p_partkey", F.concat_ws("/", "p_type", "p_brand"), "p_retailprice"),
        blocks("supplier", "C", "s_suppkey", F.col("s_name"), "s_acctbal"),
        blocks("customer", "N", "c_custkey", F.col("c_mktsegment"), "c_acctbal"),
        store,
        counted,
    )


@query("three_step_route", ROUTE_SQL)
def three_step_route(spark: SparkSession, sf: str) -> DataFrame:
    out = route(spark, sf, scratch_path(spark, "route"), counted=False)
    columns = ["ID", "SMILES", settle("PriceMol", 4).alias("PriceMol")]
    return out["imidazolones"].select(F.lit("imidazolones").alias("family"), *columns).unionByName(
        out["thiazolones"].select(F.lit("thiazolones").alias("family"), *columns)
    )


# Parts and suppliers that no oxazolone within its limit can hold are dropped before pairing.
COUNTS_SQL = """
    WITH a0 AS (SELECT p_type || '/' || p_brand AS txt, 'A' || p_partkey AS id, p_retailprice AS price FROM part WHERE p_retailprice > 0),
    c0 AS (SELECT s_name AS txt, 'C' || s_suppkey AS id, s_acctbal AS price FROM supplier WHERE s_acctbal > 0),
    a AS (SELECT * FROM a0 WHERE price <= 1150 - (SELECT min(price) FROM c0)),
    c AS (SELECT * FROM c0 WHERE price <= 1150 - (SELECT min(price) FROM a0)),
    n AS (SELECT c_mktsegment AS txt, 'N' || c_custkey AS id, c_acctbal AS price FROM customer WHERE c_acctbal > 0),
    op AS (SELECT a.txt || '.' || c.txt AS txt, a.id || c.id AS id, a.price + c.price AS price FROM a JOIN c ON a.price + c.price <= 1200),
    og AS (SELECT txt, min(price) AS price FROM op GROUP BY txt),
    ox AS (SELECT * FROM og WHERE price <= 1150),
    ip AS (SELECT ox.txt || '-' || n.txt AS txt, ox.price + n.price AS price FROM ox JOIN n ON n.price <= 1200 - ox.price),
    tp AS (SELECT txt || '=S' AS txt, price + 10 AS price FROM ox WHERE price + 10 <= 1200),
    raw AS (SELECT 'imidazolones' AS family, txt, min(price) AS price FROM ip GROUP BY txt
            UNION ALL SELECT 'thiazolones', txt, min(price) FROM tp GROUP BY txt),
    judged AS (SELECT family, CASE WHEN price > 1190 THEN 'range' WHEN regexp_matches(txt, 'Brand#1/') OR regexp_matches(txt, 'ECONOMY.*7')
               THEN 'alert' ELSE 'accepted' END AS decision FROM raw)
    SELECT 'oxazolones_raw' AS stage, unnest(['pairs', 'problematic', 'no_product', 'failed_products', 'products', 'rows']) AS counter,
      unnest([(SELECT count(*) FROM op), 0, 0, 0, (SELECT count(*) FROM op), (SELECT count(*) FROM og)]) AS n
    UNION ALL SELECT 'imidazolones_raw', unnest(['pairs', 'problematic', 'no_product', 'failed_products', 'products', 'rows']),
      unnest([(SELECT count(*) FROM ip), 0, 0, 0, (SELECT count(*) FROM ip), (SELECT count(*) FROM raw WHERE family = 'imidazolones')])
    UNION ALL SELECT 'thiazolones_raw', unnest(['pairs', 'problematic', 'no_product', 'failed_products', 'products', 'rows']),
      unnest([(SELECT count(*) FROM tp), 0, 0, 0, (SELECT count(*) FROM tp), (SELECT count(*) FROM raw WHERE family = 'thiazolones')])
    UNION ALL SELECT 'oxazolones', unnest(['accepted', 'range', 'alert']),
      unnest([(SELECT count(*) FROM ox), (SELECT count(*) FROM og WHERE price > 1150), 0])
    UNION ALL SELECT f.family, d.decision, (SELECT count(*) FROM judged j WHERE j.family = f.family AND j.decision = d.decision)
      FROM (SELECT unnest(['imidazolones', 'thiazolones']) AS family) f, (SELECT unnest(['accepted', 'range', 'alert']) AS decision) d
"""


@query("library_counts", COUNTS_SQL)
def library_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What each stage of the route has counted while it was written."""
    store = scratch_path(spark, "route")
    route(spark, sf, store, condensation_deltas={"PriceMol": 0.0})
    return counts_of(spark, store)


@query(
    "cheapest_per_key",
    """SELECT l_partkey, l_orderkey, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def cheapest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_partkey", "l_orderkey", "l_extendedprice")
    return dedupe.cheapest_per_key(li, "l_partkey", "l_extendedprice", "l_orderkey")


@query(
    "most_complete_per_key",
    """WITH m AS (
         SELECT user_id, event_id, CASE WHEN value < 50 THEN value END AS m1,
                CASE WHEN event_type <> 'error' THEN value END AS m2,
                CASE WHEN event_type IN ('click', 'view') THEN value END AS m3 FROM events)
       SELECT user_id, event_id, m1, m2, m3 FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY
           (m1 IS NOT NULL)::INT + (m2 IS NOT NULL)::INT + (m3 IS NOT NULL)::INT DESC, event_id) AS rn FROM m) WHERE rn = 1""",
)
def most_complete_per_key(spark: SparkSession, sf: str) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    m = table(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.when(v < 50, v).alias("m1"),
        F.when(kind != "error", v).alias("m2"),
        F.when(kind.isin("click", "view"), v).alias("m3"),
    )
    return dedupe.most_complete_per_key(m, "user_id", ["m1", "m2", "m3"], "event_id")


@query(
    "first_nonblank",
    """SELECT conv_id, text FROM (
         SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
         FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE '' END AS text FROM conversations)
         WHERE text <> '' AND conv_id IS NOT NULL) WHERE rn = 1""",
)
def first_nonblank(spark: SparkSession, sf: str) -> DataFrame:
    answers = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", F.col("text")).otherwise("").alias("text")
    )
    return dedupe.first_nonblank_per_key(answers, "conv_id", "text", "turn")


@query(
    "unique_names",
    """WITH named AS (
         SELECT conv_id, turn, CASE WHEN trim(role) = '' THEN 'MOL' ELSE trim(role) END AS base FROM conversations),
       tokens AS (
         SELECT conv_id, turn, regexp_replace(base || '__' || substr(sha256(base || '|' || conv_id), 1, 12),
                '[^A-Za-z0-9_.-]', '_', 'g') AS token FROM named)
       SELECT conv_id, turn, CASE WHEN rn = 1 THEN token ELSE token || '__d' || (rn - 1) END AS unique_id
       FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY turn) AS rn FROM tokens)""",
)
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations", "conv_id", "turn", "role")
    return dedupe.unique_names(rows, "role", "conv_id", "turn").select("conv_id", "turn", "unique_id")


@query("prefix_ids", """SELECT p_partkey, 'A' || row_number() OVER (ORDER BY p_partkey) AS "ID" FROM part""")
def prefix_ids(spark: SparkSession, sf: str) -> DataFrame:
    return order.prefix_ids(table(spark, sf, "part", "p_partkey"), "p_partkey", "A")


# --- rules ------------------------------------------------------------------------------------

LINE_LIMITS = [
    Limit("l_quantity", ">", 45.0, 1, "qty"),
    Limit("l_quantity", "<", 3.0, 1, "qty"),
    Limit("l_linenumber", ">", 6, None, "line"),
    Limit("l_discount", ">", 0.09, 2, "disc"),
    Limit("l_tax", ">", 0.07, 2, "tax"),
    Limit("l_extendedprice", ">", 90000.0, 1, "price"),
    Limit("l_linenumber", "<=", 0, None, "line"),
]
LINE_FAIL_SQL = """(l_quantity > 45 OR l_quantity < 3 OR l_linenumber > 6 OR l_discount > 0.09 OR l_tax > 0.07
                    OR l_extendedprice > 90000 OR l_linenumber <= 0)"""


@query(
    "range_filter_rejected",
    f"""SELECT l_orderkey, l_linenumber, l_partkey,
          concat_ws('; ', CASE WHEN l_quantity > 45 THEN 'qty=' || printf('%.1f', l_quantity) || '>45.0' END,
            CASE WHEN l_quantity < 3 THEN 'qty=' || printf('%.1f', l_quantity) || '<3.0' END,
            CASE WHEN l_linenumber > 6 THEN 'line=' || l_linenumber || '>6' END,
            CASE WHEN l_discount > 0.09 THEN 'disc=' || printf('%.2f', l_discount) || '>0.09' END,
            CASE WHEN l_tax > 0.07 THEN 'tax=' || printf('%.2f', l_tax) || '>0.07' END,
            CASE WHEN l_extendedprice > 90000 THEN 'price=' || printf('%.1f', l_extendedprice) || '>90000.0' END,
            CASE WHEN l_linenumber <= 0 THEN 'line=' || l_linenumber || '<=0' END) AS "Rejection"
        FROM lineitem WHERE {LINE_FAIL_SQL}""",
)
def range_filter_rejected(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = rules.range_filter(
        table(spark, sf, "lineitem"), LINE_LIMITS, rejected_columns=["l_orderkey", "l_linenumber", "l_partkey"]
    )
    return rejected


@query(
    "range_filter_accepted",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem WHERE NOT {LINE_FAIL_SQL}",
)
def range_filter_accepted(spark: SparkSession, sf: str) -> DataFrame:
    accepted, _ = rules.range_filter(table(spark, sf, "lineitem"), LINE_LIMITS)
    return accepted.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query(
    "derived_limits",
    """SELECT p_partkey, p_retailprice, p_size FROM part,
         (SELECT min(s_acctbal) AS bal, min(s_nationkey) AS nat FROM supplier WHERE s_acctbal > 0) m
       WHERE p_retailprice <= 1200.0 - 200.5 - bal AND p_size <= 45.0 - 5.0 - nat""",
)
def derived_limits(spark: SparkSession, sf: str) -> DataFrame:
    partner = rules.valid_price(table(spark, sf, "supplier"), "s_acctbal").select(
        F.col("s_acctbal").alias("p_retailprice"), F.col("s_nationkey").alias("p_size")
    )
    limits = rules.derive_limits(
        {"p_retailprice": 1200.0, "p_size": 45.0}, {"p_retailprice": 200.5, "p_size": 5.0}, partner
    )
    part = table(spark, sf, "part", "p_partkey", "p_retailprice", "p_size")
    return rules.range_filter(part, [Limit(c, ">", v) for c, v in limits.items()])[0]


@query(
    "rule_set_violations",
    """WITH r AS (
         SELECT l_orderkey, l_linenumber, l_partkey,
           coalesce(l_quantity <= 40 AND l_discount <= 0.08, false) AS r1,
           coalesce(l_extendedprice BETWEEN 2000 AND 80000 AND l_tax <= 0.07, false) AS r2,
           coalesce(o_totalprice <= 400000 AND l_linenumber <= 6, false) AS r3,
           coalesce(o_orderstatus <> 'P' AND l_returnflag <> 'R', false) AS r4,
           coalesce(l_quantity >= 2 AND o_totalprice >= 5000, false) AS r5
         FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
       v AS (
         SELECT *, (NOT r1)::INT + (NOT r2)::INT + (NOT r3)::INT + (NOT r4)::INT + (NOT r5)::INT AS fails,
           concat_ws(', ', CASE WHEN NOT r1 THEN 'Small' END, CASE WHEN NOT r2 THEN 'Price' END,
             CASE WHEN NOT r3 THEN 'Order' END, CASE WHEN NOT r4 THEN 'Status' END, CASE WHEN NOT r5 THEN 'Floor' END) AS names
         FROM r)
       SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN names = '' THEN 'none' ELSE names END AS "Violation",
              CASE WHEN fails <= 1 THEN 'accepted' ELSE 'rejected' END AS decision FROM v""",
)
def rule_set_violations(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    lines = li.join(o, li.l_orderkey == o.o_orderkey, "left")
    c = F.col
    named = {
        "Small": (c("l_quantity") <= 40) & (c("l_discount") <= 0.08),
        "Price": c("l_extendedprice").between(2000, 80000) & (c("l_tax") <= 0.07),
        "Order": (c("o_totalprice") <= 400000) & (c("l_linenumber") <= 6),
        "Status": (c("o_orderstatus") != "P") & (c("l_returnflag") != "R"),
        "Floor": (c("l_quantity") >= 2) & (c("o_totalprice") >= 5000),
    }
    return rules.tag_rule_set(lines, named).select("l_orderkey", "l_linenumber", "l_partkey", "Violation", "decision")


@query(
    "clean_key_counts",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE text IS NULL) AS n_missing,
              count(*) FILTER (WHERE trim(text) = '') AS n_blank,
              count(*) FILTER (WHERE trim(text) <> '' AND length(trim(text)) < 200) AS n_invalid,
              count(*) FILTER (WHERE trim(text) <> '' AND length(trim(text)) >= 200) AS n_kept
       FROM documents""",
)
def clean_key_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rules.clean_key_counts(table(spark, sf, "documents", "text"), "text", lambda t: F.length(t) >= 200)


@query(
    "clean_key",
    """SELECT doc_id, trim(lang) AS key FROM documents WHERE trim(lang) <> '' AND trim(lang) <> 'de'""",
)
def clean_key(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "lang")
    return rules.clean_key(docs, ["language", "lang"], "key", lambda k: k != "de")


@query(
    "class_filter",
    """SELECT count(*) FILTER (WHERE regexp_matches(p_type, '^(ECONOMY|SMALL)')) AS n_in_class,
              count(*) FILTER (WHERE p_type IS NULL OR trim(p_type) = '') AS n_invalid,
              count(*) FILTER (WHERE trim(p_type) <> '' AND NOT regexp_matches(p_type, '^(ECONOMY|SMALL)')) AS n_not_in_class
       FROM part""",
)
def class_filter(spark: SparkSession, sf: str) -> DataFrame:
    return rules.class_filter(table(spark, sf, "part", "p_type"), "p_type", lambda t: t.rlike("^(ECONOMY|SMALL)"))[1]


@query(
    "derived_columns",
    """SELECT l_orderkey, l_linenumber, l_partkey, floor((l_extendedprice * (1 - l_discount)) * 1e4 + 0.5001) / 1e4 AS net, l_quantity
       FROM lineitem""",
)
def derived_columns(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    filled = rules.ensure_columns(
        li, {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "l_quantity": F.lit(-1.0)}
    )
    placed = fn.insert_after(filled, "net", settle("net", 4), "l_partkey")
    return fn.keep_existing(placed, ["l_orderkey", "l_linenumber", "l_partkey", "net", "no_such_column", "l_quantity"])


@query(
    "threshold_candidates",
    """SELECT o_orderkey FROM orders WHERE o_totalprice <= 450000 AND o_totalprice >= 1000
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def threshold_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rules.threshold_candidates(
        table(spark, sf, "orders"), 50, "o_totalprice", "o_orderkey", "o_totalprice", 450000.0, 1000.0
    )


@query(
    "stage_counters",
    """SELECT count(*) AS n_rows, count(*) FILTER (WHERE l_returnflag = 'N') AS output_rows,
              count(*) FILTER (WHERE l_extendedprice > 80000) AS skipped_price,
              count(*) FILTER (WHERE l_quantity < 2) AS no_product,
              floor((count(*) FILTER (WHERE l_returnflag = 'N') * 100.0 / count(*)) * 1e6 + 0.5001) / 1e6 AS accepted_pct
       FROM lineitem""",
)
def counters(spark: SparkSession, sf: str) -> DataFrame:
    return stage_counters(
        table(spark, sf, "lineitem"),
        {
            "output_rows": F.col("l_returnflag") == "N",
            "skipped_price": F.col("l_extendedprice") > 80000,
            "no_product": F.col("l_quantity") < 2,
        },
    ).withColumn("accepted_pct", settle("accepted_pct", 6))


# --- screens ----------------------------------------------------------------------------------

CATALOGUE = [
    Alert(1, "First", "mail", r"[A-Za-z0-9._]+@[A-Za-z0-9-]+[.][A-Za-z]+"),
    Alert(1, "First", "licence", r"[Ll]icen[cs]e|[Cc]opyright"),
    Alert(1, "First", "digits", r"[0-9]{9}"),
    Alert(2, "Second(a)", "address", r"https?://"),
    Alert(2, "Second(a)", "key", r"[A-Fa-f0-9]{24}"),
    Alert(2, "Second(b)", "article", r"(^| )(The|Der|Le|El) "),
    Alert(2, "Second(c)", "year", r"(19|20)[0-9]{2}"),
]
SCREEN_CASES = "\n".join(f"WHEN regexp_matches(text, '{a.pattern}') THEN '{a.family}|{a.name}'" for a in CATALOGUE)
SCREEN_SQL = f"""
    hits AS (SELECT doc_id, n_chars, CASE {SCREEN_CASES} END AS hit FROM documents)
"""


@query(
    "alert_screen_two_tier",
    f"""WITH {SCREEN_SQL}
    SELECT doc_id, split_part(hit, '|', 1) AS "MatchAlert", split_part(hit, '|', 2) AS "Substructure"
    FROM hits WHERE hit IS NOT NULL""",
)
def alert_screen_two_tier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    return screen.alert_screen(docs, "text", CATALOGUE, rejected_columns=["doc_id"])[1]


@query(
    "filter_and_screen",
    f"""WITH {SCREEN_SQL}
    SELECT doc_id, CASE WHEN n_chars > 4000 THEN 'range' WHEN hit IS NOT NULL THEN 'alert' ELSE 'accepted' END AS stage
    FROM hits""",
)
def filter_and_screen(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text", "n_chars")
    return screen.decide(docs, [Limit("n_chars", ">", 4000)], "text", CATALOGUE).select("doc_id", F.col("decision").alias("stage"))


@query(
    "match_export",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, trim(source) AS source,
              CAST(n_chars AS DOUBLE) AS off_median, CAST(length(lang) AS DOUBLE) AS on_median,
              floor((n_chars / CAST(length(lang) AS DOUBLE)) * 1e6 + 0.5001) / 1e6 AS "SI_median",
              CAST(n_chars * 2 AS DOUBLE) AS off_mean, CASE WHEN lang = 'en' THEN 0.0 ELSE 4.0 END::DOUBLE AS on_mean,
              CASE WHEN lang <> 'en' THEN floor((n_chars * 2 / 4.0) * 1e6 + 0.5001) / 1e6 END AS "SI_mean"
       FROM documents WHERE trim(source) <> '' AND regexp_matches(trim(source), '^src1')""",
)
def match_export(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        F.col("n_chars").alias("off_median"),
        F.length("lang").alias("on_median"),
        (F.col("n_chars") * 2).alias("off_mean"),
        F.when(F.col("lang") == "en", 0.0).otherwise(4.0).alias("on_mean"),
    )
    found = screen.match_export(docs, lambda k: k.rlike("^src1"), "doc_id", "source", "on", "off")
    return found.withColumns({c: settle(c, 6) for c in ("SI_median", "SI_mean")})


# --- ids and labels ---------------------------------------------------------------------------


@query(
    "id_functions",
    """SELECT l_partkey, l_suppkey, l_linenumber,
              'A' || l_partkey || 'C' || l_suppkey AS pair_id,
              'A' || l_partkey || 'C' || l_suppkey || 'N' || l_linenumber AS triple_id,
              'A' || l_partkey AS head, 'A' || l_partkey || 'C' || l_suppkey AS without_tail,
              substr(sha256(l_partkey || '|' || l_suppkey), 1, 16) AS key16,
              'lig_' || l_partkey AS ligand, 'R' || l_suppkey AS receptor
       FROM lineitem""",
)
def id_functions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_linenumber")
    pair = fn.pair_id(F.concat(F.lit("A"), "l_partkey"), F.concat(F.lit("C"), "l_suppkey"))
    ligand, receptor = fn.stem_parts(F.concat(F.lit("lig_"), "l_partkey", F.lit("_R"), "l_suppkey"))
    named = li.withColumn("pair_id", pair)
    named = named.withColumn("triple_id", fn.extend_id("pair_id", F.concat(F.lit("N"), "l_linenumber")))
    return named.select(
        "*",
        fn.id_head("pair_id").alias("head"),
        fn.id_without_tail("triple_id").alias("without_tail"),
        fn.content_key(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("key16"),
        ligand.alias("ligand"),
        receptor.alias("receptor"),
    )


@query(
    "label_format",
    """SELECT l_orderkey, l_linenumber, l_partkey, printf('%.1f', l_extendedprice) AS one,
              printf('%.2f', l_extendedprice / 8) AS two, printf('%.1f', -l_tax * 2.5) AS three
       FROM lineitem""",
)
def label_format(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        fn.fixed("l_extendedprice", 1).alias("one"),
        fn.fixed(F.col("l_extendedprice") / 8, 2).alias("two"),
        fn.fixed(-F.col("l_tax") * 2.5, 1).alias("three"),
    )
