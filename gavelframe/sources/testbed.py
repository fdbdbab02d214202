"""Domain tables derived from the star-schema tables of a test folder.

Every derivation is one SQL expression that Spark and any ANSI engine read alike, so
the same text feeds the Spark queries and the SQL they are checked against
(``cte`` gives it as a WITH clause).

========================  ==============================================================
transactions              lineitem with its part and supplier: one sale per line
listings                  all lines as listings, one per line
adjudications             all orders with their customer
agents                    suppliers
site_one, site_two        two listing feeds for record linkage, from supplier, customer
visits                    events as visit rows (January 2024)
notice_texts              a templated French notice per supplier
========================  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-01-01"
VISIT_AS_OF = "2024-01-15"

_POSTAL = (
    "CASE {nation} % 4"
    " WHEN 0 THEN '750' || lpad(CAST(1 + {key} % 20 AS STRING), 2, '0')"
    " WHEN 1 THEN '92' || CAST(100 + 10 * ({key} % 10) AS STRING)"
    " WHEN 2 THEN '93' || CAST(100 + 10 * ({key} % 10) AS STRING)"
    " ELSE '94' || CAST(100 + 10 * ({key} % 10) AS STRING) END"
)
_COURT = (
    "CASE {nation} % 4 WHEN 0 THEN 'Tribunal Judiciaire de Paris'"
    " WHEN 1 THEN 'Tribunal Judiciaire de Nanterre'"
    " WHEN 2 THEN 'Tribunal Judiciaire de Bobigny'"
    " ELSE 'Tribunal Judiciaire de Créteil' END"
)
_CITIES = ["Paris", "Nanterre", "Courbevoie", "Colombes", "Antony", "Clamart", "Montrouge", "Meudon", "Suresnes",
           "Puteaux", "Clichy", "Malakoff", "Vanves", "Saint-Denis", "Montreuil", "Drancy", "Pantin", "Bondy", "Bobigny",
           "Saint-Ouen", "Créteil", "Villejuif", "Vincennes", "Alfortville", "Saint-Mandé"]
_CITY = "CASE {nation} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CITIES)) + " END"
_LINE_KEY = (
    "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)"
    " || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(l_shipdate AS DATE) AS STRING)"
    " || '-' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)"
)
_SURFACE = "CASE WHEN l_quantity = {null_at} THEN NULL WHEN l_quantity = {zero_at} THEN 0.0 ELSE CAST(p_size AS DOUBLE) END"

_LINES = ("lineitem", [("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey"),
                       ("nation", "s_nationkey", "n_nationkey")])

_TX_SURFACE = _SURFACE.format(null_at=13, zero_at=17)

TABLES: dict[str, dict] = {
    "transactions": {
        "from": _LINES,
        "where": None,
        "columns": {
            "tx_key": _LINE_KEY,
            "tx_date": "CASE WHEN l_quantity = 23 THEN NULL ELSE CAST(l_shipdate AS DATE) END",
            "nature": "CASE l_returnflag WHEN 'A' THEN 'Vente' WHEN 'N' THEN 'Adjudication' ELSE 'Echange' END",
            "price": "l_extendedprice",
            "address": "CAST(l_linenumber AS STRING) || ' rue ' || p_name",
            "postal_code": _POSTAL.format(nation="s_nationkey", key="s_suppkey"),
            "commune": "n_name",
            "local_type": "CASE p_type WHEN 'MEDIUM' THEN 'Maison' WHEN 'LARGE' THEN 'Maison'"
                          " WHEN 'ECONOMY' THEN 'Local industriel. commercial ou assimilé'"
                          " WHEN 'PROMO' THEN 'Dépendance' ELSE 'Appartement' END",
            "surface_m2": _TX_SURFACE,
            "rooms": "CAST(1 + p_size % 6 AS INT)",
            "price_m2": f"CASE WHEN ({_TX_SURFACE}) > 0 THEN l_extendedprice / ({_TX_SURFACE}) END",
        },
    },
    "listings": {
        "from": _LINES,
        "where": None,
        "columns": {
            "listing_key": _LINE_KEY,
            "source": "CASE l_suppkey % 3 WHEN 0 THEN 'site_a' WHEN 1 THEN 'site_b' ELSE 'site_c' END",
            "url": "'https://www.annonces.example/annonce/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING)",
            "address": "CAST(l_linenumber AS STRING) || ' rue ' || p_name",
            "postal_code": "CASE WHEN l_quantity = 41 THEN NULL ELSE " + _POSTAL.format(nation="s_nationkey", key="s_suppkey") + " END",
            "city": "CASE WHEN l_quantity = 43 THEN NULL ELSE n_name END",
            "property_type": "CASE p_type WHEN 'STANDARD' THEN 'appartement' WHEN 'MEDIUM' THEN 'maison'"
                             " WHEN 'LARGE' THEN 'maison' WHEN 'ECONOMY' THEN 'local_commercial'"
                             " WHEN 'PROMO' THEN 'parking' ELSE 'autre' END",
            "surface_m2": _SURFACE.format(null_at=31, zero_at=33),
            "rooms": "CAST(1 + p_size % 6 AS INT)",
            "description": "CASE l_linenumber % 4 WHEN 0 THEN 'Bien occupé par un locataire' WHEN 1 THEN 'Travaux à prévoir'"
                           " WHEN 2 THEN 'Libre de toute occupation' ELSE '' END",
            "sale_date": "CAST(l_shipdate AS DATE)",
            "start_price": "CASE WHEN l_quantity = 37 THEN NULL ELSE l_extendedprice * (1 - l_discount) END",
            "court": _COURT.format(nation="s_nationkey"),
            "agent_id": "s_suppkey",
            "agent_name": "s_name",
            "report_url": "CASE WHEN l_returnflag = 'A' THEN 'https://docs.example/pv_' || CAST(l_orderkey AS STRING) || '.pdf' END",
            "status": "CASE WHEN l_shipdate >= DATE '1998-01-01' THEN 'a_venir' WHEN l_linestatus = 'F' THEN 'adjuge' ELSE 'annule' END",
            # two visit slots, NULL when not planned
            "visit_one": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS TIMESTAMP) - INTERVAL '10' DAY + INTERVAL '14' HOUR END",
            "visit_two": "CASE WHEN l_linenumber % 3 = 2 THEN CAST(l_shipdate AS TIMESTAMP) - INTERVAL '3' DAY + INTERVAL '10' HOUR END",
        },
    },
    "adjudications": {
        "from": ("orders", [("customer", "o_custkey", "c_custkey")]),
        "where": None,
        "columns": {
            "source": "CASE o_orderkey % 2 WHEN 0 THEN 'site_a' ELSE 'site_b' END",
            "source_url": "'https://ventes.example/' || CAST(o_orderkey AS STRING)",
            "sale_date": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
            "postal_code": _POSTAL.format(nation="c_nationkey", key="c_custkey"),
            "city": "CASE c_nationkey % 3 WHEN 0 THEN NULL ELSE 'Ville ' || CAST(c_nationkey AS STRING) END",
            "property_type": "CASE o_orderkey % 3 WHEN 0 THEN 'Appartement' WHEN 1 THEN 'Maison' ELSE 'Local' END",
            "surface_m2": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(20 + c_custkey % 80 AS DOUBLE) END",
            "rooms": "CAST(1 + c_custkey % 5 AS INT)",
            "start_price": "o_totalprice * 0.5",
            "hammer_price": "o_totalprice",
            "court": _COURT.format(nation="c_nationkey"),
        },
    },
    "agents": {
        "from": ("supplier", []),
        "where": None,
        "columns": {
            "agent_id": "s_suppkey",
            "name": "s_name",
            "firm": "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'SCP ' || CAST(s_nationkey AS STRING) END",
            "phone": "'01 40 00 00 ' || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0')",
            "email": "'contact' || CAST(s_suppkey AS STRING) || '@avocats.example'",
            "site": "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'https://cabinet' || CAST(s_suppkey AS STRING) || '.example' END",
        },
    },
    "visits": {
        "from": ("events", []),
        "where": None,
        "columns": {
            "visit_id": "event_id",
            "listing_key": "user_id",
            "visit_at": "ts",
            "kind": "event_type",
            "amount": "value",
        },
    },
    "site_one": {
        "from": ("supplier", [("nation", "s_nationkey", "n_nationkey")]),
        "where": None,
        "columns": {
            "seq": "s_suppkey",
            "source": "'site_a'",
            "url": "'https://a.example/annonce/' || CAST(s_suppkey AS STRING)",
            "sale_date": "CASE WHEN s_suppkey % 17 = 5 THEN NULL ELSE DATE '1998-01-01' + CAST(s_suppkey % 40 AS INT) END",
            "court": "CASE WHEN s_suppkey % 11 = 3 THEN NULL ELSE " + _COURT.format(nation="s_nationkey") + " END",
            "start_price": "CASE WHEN s_acctbal > 0 THEN s_acctbal * 20 ELSE NULL END",
            "city": "CASE WHEN s_suppkey % 13 = 4 THEN NULL ELSE " + _CITY.format(nation="s_nationkey") + " END",
            "property_type": "CASE s_suppkey % 3 WHEN 0 THEN 'appartement' WHEN 1 THEN 'maison' ELSE 'parking' END",
            "surface_m2": "CASE WHEN s_suppkey % 19 = 6 THEN NULL ELSE CAST(20 + s_suppkey % 60 AS DOUBLE) END",
            "postal_code": "CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN '9' ELSE "
                           + _POSTAL.format(nation="s_nationkey", key="s_suppkey") + " END",
            "address": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey AS STRING) || ' rue ' || n_name END",
            "rooms": "CAST(s_suppkey % 5 AS INT)",
            "description": "'Vente ' || s_name",
            "agent_name": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END",
            "report_url": "CASE WHEN s_suppkey % 3 = 1 THEN 'https://a.example/pv.pdf' END",
        },
    },
    "site_two": {
        "from": ("customer", [("nation", "c_nationkey", "n_nationkey")]),
        "where": None,
        "columns": {
            "seq": "c_custkey",
            "source": "'site_b'",
            "url": "'https://b.example/lot_' || CAST(c_custkey AS STRING)",
            "sale_date": "CASE WHEN c_custkey % 23 = 5 THEN NULL ELSE DATE '1998-01-01' + CAST(c_custkey % 40 AS INT) END",
            "court": "CASE WHEN c_custkey % 7 = 3 THEN NULL ELSE " + _COURT.format(nation="c_nationkey") + " END",
            "start_price": "CASE WHEN c_acctbal > 0 THEN c_acctbal * 20 ELSE NULL END",
            "city": "CASE WHEN c_custkey % 9 = 4 THEN NULL ELSE lower(replace(" + _CITY.format(nation="c_nationkey") + ", '-', ' ')) END",
            "property_type": "CASE c_custkey % 3 WHEN 0 THEN 'appartement' WHEN 1 THEN 'maison' ELSE 'parking' END",
            "surface_m2": "CASE WHEN c_custkey % 29 = 6 THEN NULL ELSE CAST(20 + c_custkey % 60 AS DOUBLE) END",
            "postal_code": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE " + _POSTAL.format(nation="c_nationkey", key="c_custkey") + " END",
            "address": "CAST(c_custkey AS STRING) || ' avenue ' || n_name",
            "rooms": "CAST(c_custkey % 4 AS INT)",
            "description": "'Lot ' || c_mktsegment",
            "agent_name": "c_name",
            "report_url": "CASE WHEN c_custkey % 2 = 0 THEN 'https://b.example/pv.pdf' END",
        },
    },
    "notice_texts": {
        "from": ("supplier", [("nation", "s_nationkey", "n_nationkey")]),
        "where": None,
        "columns": {
            "page_id": "s_suppkey",
            "url": "CASE s_suppkey % 3"
                   " WHEN 0 THEN 'https://www.site-a.example/annonce/' || CAST(s_suppkey AS STRING) || '/' || lower(n_name) || '.html'"
                   " WHEN 1 THEN 'https://www.site-b.example/' || CAST(s_suppkey AS STRING) || '-vente-' || lower(n_name)"
                   " ELSE 'https://www.site-c.example/encheres/immobilier/appartements/' || lower(replace(n_name, ' ', '-')) || '-92/bien_' || CAST(s_suppkey AS STRING) END",
            "body": "CASE s_suppkey % 4"
                    " WHEN 0 THEN 'Un appartement de type T3 de ' || CAST(20 + s_suppkey % 80 AS STRING) || ',5 m², 3 pièces dont 2 chambres, au ' || CAST(1 + s_suppkey % 6 AS STRING) || 'ème étage, '"
                    " WHEN 1 THEN 'Une maison avec jardin, surface habitable de ' || CAST(60 + s_suppkey % 90 AS STRING) || ' m2, 5 pièces, '"
                    " WHEN 2 THEN 'Un local commercial de ' || CAST(30 + s_suppkey % 50 AS STRING) || '.25 m², '"
                    " ELSE 'Un parking en sous-sol, lot n°' || CAST(s_suppkey % 200 AS STRING) || ', ' END"
                    " || CASE WHEN s_suppkey % 7 = 6 THEN 'situé quartier des Chartreux ' ELSE CAST(1 + s_suppkey % 150 AS STRING) || ', rue de la République, ' END"
                    " || CASE s_suppkey % 7 WHEN 3 THEN 'à Marseille ' || CAST(1 + s_suppkey % 16 AS STRING) || 'ème' WHEN 5 THEN 'commune de La Seyne-sur-Mer' ELSE "
                    + _POSTAL.format(nation="s_nationkey", key="s_suppkey") + " || ' Ville-' || n_name END || '\n'"
                    " || CASE s_suppkey % 3 WHEN 0 THEN 'Mise à prix : ' || CAST(10 + s_suppkey % 90 AS STRING) || ' 000 €'"
                    " WHEN 1 THEN 'mise a prix: ' || CAST(1 + s_suppkey % 9 AS STRING) || '.250.000,50 euros'"
                    " ELSE 'Prix : ' || CAST(100 + s_suppkey % 900 AS STRING) || ' 500 €' END || '\n'"
                    " || CASE s_suppkey % 5 WHEN 0 THEN 'Vente le 31/02/2024 à 10h'"
                    " WHEN 1 THEN 'Adjudication le ' || CAST(1 + s_suppkey % 28 AS STRING) || ' février 2024 à 14h30'"
                    " WHEN 2 THEN 'Audience le ' || lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0') || '/03/2024 à 9h00'"
                    " WHEN 3 THEN 'Vente le 1er aout 2024'"
                    " ELSE 'Date inconnue' END || '\n'"
                    " || CASE s_suppkey % 4 WHEN 0 THEN 'Visite sur place lundi ' || CAST(1 + s_suppkey % 28 AS STRING) || ' janvier 2024 de 14h à 15h'"
                    " WHEN 1 THEN 'Visites : 05/01/2024 et 12/01/2024'"
                    " WHEN 2 THEN 'Visites le ' || CAST(1 + s_suppkey % 28 AS STRING) || ' décembre 2023 à 9h'"
                    " ELSE 'Sans visite' END || '\n'"
                    " || 'Tribunal Judiciaire de ' || CASE s_nationkey % 4 WHEN 0 THEN 'Paris' WHEN 1 THEN 'Nanterre' WHEN 2 THEN 'Bobigny' ELSE 'Créteil' END || '\n'"
                    " || CASE s_suppkey % 3 WHEN 0 THEN 'Bien occupé, locataire : M. Durand, loyer mensuel : 1 ' || CAST(100 + s_suppkey % 900 AS STRING) || ',00 €'"
                    " WHEN 1 THEN 'Libre de toute occupation' ELSE 'Occupation : inconnue' END || '\n'"
                    " || CASE WHEN s_suppkey % 2 = 0 THEN 'Copropriété, lot n°' || CAST(s_suppkey % 300 AS STRING) || ', charges annuelles : 1 ' || CAST(100 + s_suppkey % 800 AS STRING) || ' €, ' || CAST(s_suppkey % 1000 AS STRING) || '/10000 tantièmes' ELSE '' END || '\n'"
                    " || 'Section AB n° ' || CAST(s_suppkey AS STRING) || ' DPE : ' || CASE s_suppkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'G' ELSE 'A' END || ', amiante : absence\n'"
                    " || 'Frais prévisionnels : 4 500,25 € ; créance : ' || CAST(100 + s_suppkey % 100 AS STRING) || ' 000 € ; RG 23/0' || CAST(s_suppkey AS STRING) || '\n'"
                    " || 'Maître Jeanne Dupont, SCP Martin et Associés, Tél : 01 40 20 30 ' || lpad(CAST(s_suppkey % 100 AS STRING), 2, '0') || ' contact@cabinet' || CAST(s_suppkey AS STRING) || '.example.fr\n'"
                    " || CASE WHEN s_suppkey % 3 = 1 THEN CAST(1 + s_suppkey % 90 AS STRING) || ' rue du Palais - 75001 Paris\n' ELSE '' END"
                    " || 'Désignation : le bien comprend une entrée, un séjour, une cuisine, une salle de bains, des toilettes et une cave, le tout en bon état général et sans travaux urgents à prévoir.'",
        },
    },
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def domain(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table as a DataFrame over the folder's parquet files."""
    spec = TABLES[name]
    base, joins = spec["from"]
    df = read(spark, sf_dir, base)
    if spec["where"]:
        df = df.filter(spec["where"])
    for table, left, right in joins:
        other = read(spark, sf_dir, table)
        if table == "nation":
            other = F.broadcast(other)  # 25 rows at every scale
        df = df.join(other, df[left] == other[right])
    return df.select(*[F.expr(text).alias(c) for c, text in spec["columns"].items()])


def transactions(spark, sf_dir):
    return domain(spark, sf_dir, "transactions")


def listings(spark, sf_dir):
    """Listings with their visit slots as an array."""
    return domain(spark, sf_dir, "listings").withColumn(
        "visit_times", F.array_compact(F.array("visit_one", "visit_two")))


def _cte_body(name: str) -> str:
    spec = TABLES[name]
    base, joins = spec["from"]
    cols = ",\n    ".join(f"{text} AS {c}" for c, text in spec["columns"].items())
    text = f"SELECT {cols}\n  FROM {base}"
    for table, left, right in joins:
        text += f" JOIN {table} ON {left} = {right}"
    if spec["where"]:
        text += f"\n  WHERE {spec['where']}"
    return text


def cte(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the named domain tables."""
    return "WITH " + ",\n".join(f"{n} AS (\n  {_cte_body(n)})" for n in names)
