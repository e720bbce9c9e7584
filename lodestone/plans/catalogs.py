"""Catalog, policy and evaluation queries over small governed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import catalog, evaluation, policy, rewrite
from lodestone.plans.base import ENDPOINTS, IDENTITIES, INCOMING, INDEXES, NEW_ENDPOINTS, PROMPTS, RECIPES, RUNS, SOURCES, Fixture, load, query, tagged, with_fixtures

ACTIVE_SQL = "status IN ('curated', 'published')"


@query("list_sources", with_fixtures(f"SELECT s.slug, name, family, status, document_count FROM sources s LEFT JOIN indexes i ON i.id = active_index WHERE {ACTIVE_SQL}", SOURCES, INDEXES))
def list_sources(spark, sf_dir):
    return catalog.list_sources(SOURCES.frame(spark, sf_dir), INDEXES.frame(spark, sf_dir))


@query("describe_source", with_fixtures("SELECT s.slug, string_agg(text, ' | ' ORDER BY pos) AS prompts, nullif(count(text), 0) AS n_prompts FROM sources s LEFT JOIN prompts p USING (slug) GROUP BY s.slug", SOURCES, PROMPTS))
def describe_source(spark, sf_dir):
    return catalog.describe_source(SOURCES.frame(spark, sf_dir), PROMPTS.frame(spark, sf_dir))


@query("active_recipe", with_fixtures("SELECT s.slug, location, version, model, url FROM sources s JOIN indexes i ON i.id = active_index JOIN recipes r ON r.id = recipe_id", SOURCES, INDEXES, RECIPES))
def active_recipe(spark, sf_dir):
    return catalog.active_recipe(SOURCES.frame(spark, sf_dir), INDEXES.frame(spark, sf_dir), RECIPES.frame(spark, sf_dir))


@query("endpoint_resolve", with_fixtures("SELECT slug, version, model, CASE WHEN model IS NOT NULL THEN coalesce(e.status, 'unknown') END AS health, coalesce(e.url, r.url) AS endpoint FROM recipes r LEFT JOIN endpoints e ON model_name = model", RECIPES, ENDPOINTS))
def endpoint_resolve(spark, sf_dir):
    return catalog.endpoint_health(RECIPES.frame(spark, sf_dir), ENDPOINTS.frame(spark, sf_dir))


@query("latest_runs", with_fixtures("SELECT slug, run_id, row_number() OVER (PARTITION BY slug ORDER BY started DESC NULLS LAST, run_id DESC) AS position, status, epoch_us(completed)::DOUBLE / 1e6 - epoch_us(started)::DOUBLE / 1e6 AS seconds FROM runs", RUNS))
def latest_runs(spark, sf_dir):
    return catalog.latest_runs(RUNS.frame(spark, sf_dir)).withColumn("position", F.col("position").cast("long"))


@query("latest_index", with_fixtures("SELECT location, slug, id FROM (SELECT *, row_number() OVER (PARTITION BY location, slug ORDER BY built DESC, id DESC) AS n FROM indexes) WHERE n = 1", INDEXES))
def latest_index(spark, sf_dir):
    return catalog.latest_index(INDEXES.frame(spark, sf_dir))


@query("register_upsert", with_fixtures("SELECT i.slug, i.content, coalesce((SELECT min(version) FROM recipes r WHERE r.slug = i.slug AND sha256(r.content) = sha256(i.content)), coalesce((SELECT max(version) FROM recipes r WHERE r.slug = i.slug), 0) + 1) AS version, EXISTS (SELECT 1 FROM recipes r WHERE r.slug = i.slug AND r.content = i.content) AS reused FROM incoming i", RECIPES, INCOMING))
def register_upsert(spark, sf_dir):
    return catalog.register_versions(RECIPES.frame(spark, sf_dir), INCOMING.frame(spark, sf_dir))


@query("endpoint_upsert", with_fixtures("SELECT e.model_name, coalesce(n.url, e.url) AS url, e.status FROM endpoints e LEFT JOIN new_endpoints n USING (model_name) UNION ALL SELECT * FROM new_endpoints WHERE model_name NOT IN (SELECT model_name FROM endpoints)", ENDPOINTS, NEW_ENDPOINTS))
def endpoint_upsert(spark, sf_dir):
    return catalog.upsert(ENDPOINTS.frame(spark, sf_dir), NEW_ENDPOINTS.frame(spark, sf_dir), "model_name", ["url"])


@query("insert_if_absent", with_fixtures("SELECT * FROM endpoints UNION ALL SELECT * FROM new_endpoints WHERE model_name NOT IN (SELECT model_name FROM endpoints)", ENDPOINTS, NEW_ENDPOINTS))
def insert_if_absent(spark, sf_dir):
    return catalog.insert_if_absent(ENDPOINTS.frame(spark, sf_dir), NEW_ENDPOINTS.frame(spark, sf_dir), "model_name")


@query("delete_by_prefix", with_fixtures("SELECT slug FROM sources WHERE NOT starts_with(slug, 'old-')", SOURCES))
def delete_by_prefix(spark, sf_dir):
    return catalog.delete_by_prefix(SOURCES.frame(spark, sf_dir), "slug", "old-").select("slug")


CHANGES = Fixture("changes", "slug string, old string, new string", [("a", "draft", "curated"), ("b", "draft", "published"), ("c", "retired", "draft"), ("d", "curated", "curated"), ("e", "published", "curated")]).over("supplier", "s_suppkey", every=True, slug=tagged("s_suppkey"))
ALLOWED = Fixture("allowed", "old string, new string", catalog.TRANSITIONS)


@query("lifecycle_check", with_fixtures("SELECT c.* FROM changes c WHERE old <> new AND NOT EXISTS (SELECT 1 FROM allowed a WHERE a.old = c.old AND a.new = c.new)", CHANGES, ALLOWED))
def lifecycle_check(spark, sf_dir):
    return catalog.illegal_transitions(CHANGES.frame(spark, sf_dir)).select("slug", "old", "new")


@query("unique_check", with_fixtures("SELECT slug, count(*) AS n FROM recipes GROUP BY slug HAVING count(*) > 1", RECIPES))
def unique_check(spark, sf_dir):
    return catalog.duplicate_keys(RECIPES.frame(spark, sf_dir), ["slug"])


@query("catalog_search", with_fixtures("SELECT slug FROM sources WHERE (contains(lower(name), 'care') OR contains(lower(slug), 'care') OR contains(lower(coalesce(description, '')), 'care') OR len(list_filter(tags, lambda x: contains(lower(x), 'care'))) > 0)", SOURCES))
def catalog_search(spark, sf_dir):
    return catalog.search_catalog(SOURCES.frame(spark, sf_dir), "CARE").select("slug")


@query("admin_rollup", with_fixtures("SELECT status, count(*) AS n, sum((health IN ('degraded', 'failed') AND health IS NOT NULL)::INT)::BIGINT AS flagged FROM sources GROUP BY status", SOURCES))
def admin_rollup(spark, sf_dir):
    return catalog.admin_rollup(SOURCES.frame(spark, sf_dir))


@query("best_score", with_fixtures("SELECT slug, max(coalesce(recall_at_5, 0)) AS best, arg_max(run_id, (coalesce(recall_at_5, 0), -run_id)) AS run_id, count(*) AS runs FROM runs GROUP BY slug", RUNS))
def best_score(spark, sf_dir):
    return catalog.best_run(RUNS.frame(spark, sf_dir))


@query("source_card", with_fixtures("""SELECT s.slug, s.name, s.status, coalesce(r.version, 0) AS version, coalesce(r.model, '') AS model, coalesce(CASE WHEN r.id IS NOT NULL THEN i.location END, '') AS location,
coalesce((SELECT string_agg(CAST(version AS VARCHAR), ',' ORDER BY version DESC) FROM recipes x WHERE x.slug = s.slug), '') AS versions, (SELECT count(*) FROM runs x WHERE x.slug = s.slug) AS runs,
coalesce((SELECT max(recall_at_5) FROM runs x WHERE x.slug = s.slug), 0.0) AS best, (SELECT count(*) FROM prompts x WHERE x.slug = s.slug) AS n_prompts
FROM sources s LEFT JOIN indexes i ON i.id = s.active_index LEFT JOIN recipes r ON r.id = i.recipe_id""", SOURCES, INDEXES, RECIPES, RUNS, PROMPTS))
def source_card(spark, sf_dir):
    return catalog.source_card(*[f.frame(spark, sf_dir) for f in (SOURCES, INDEXES, RECIPES, RUNS, PROMPTS)])


@query("publish_gate", with_fixtures("SELECT slug FROM sources s WHERE status = 'published' OR (status = 'curated' AND EXISTS (SELECT 1 FROM indexes i WHERE i.id = active_index AND i.health = 'ok') AND EXISTS (SELECT 1 FROM runs r WHERE r.slug = s.slug) AND EXISTS (SELECT 1 FROM prompts p WHERE p.slug = s.slug))", SOURCES, INDEXES, RUNS, PROMPTS))
def publish_gate(spark, sf_dir):
    s = SOURCES.frame(spark, sf_dir)
    ready = catalog.publishable(s, INDEXES.frame(spark, sf_dir), RUNS.frame(spark, sf_dir), PROMPTS.frame(spark, sf_dir))
    return s.where("status = 'published'").select("slug").unionAll(ready)


_PAIRS = "FROM identities i JOIN sources s ON split_part(sub, '~', 2) = split_part(slug, '~', 2)"
_V = "CASE WHEN access_visibility IN ('public', 'restricted') THEN access_visibility ELSE visibility END"


def pairs(spark, sf_dir):
    """Every identity with every source of its catalog."""
    i, s = IDENTITIES.frame(spark, sf_dir), SOURCES.frame(spark, sf_dir)
    return i.join(s, F.substring_index("sub", "~", -1) == F.substring_index("slug", "~", -1))


@query("can_access", with_fixtures(f"SELECT sub, slug, coalesce((kind NOT IN ('agent', 'service', 'client') OR {ACTIVE_SQL}) AND ({_V} = 'public' OR ({_V} = 'restricted' AND ((kind = 'user' AND list_contains(groups, 'admin')) OR coalesce(list_has_any(groups, allowed_groups), false)))), false) AS can_access {_PAIRS}", IDENTITIES, SOURCES))
def can_access(spark, sf_dir):
    return policy.can_access(pairs(spark, sf_dir)).select("sub", "slug", "can_access")


@query("can_write", with_fixtures(f"SELECT sub, slug, coalesce({ACTIVE_SQL} AND coalesce(w_allowed, false) AND list_contains(scopes, coalesce(nullif(w_scope, ''), 'sources.write')) AND coalesce(list_contains(w_modes, 'upsert'), false) AND (coalesce(len(w_groups), 0) = 0 OR list_has_any(groups, w_groups)), false) AS can_write {_PAIRS}", IDENTITIES, SOURCES))
def can_write(spark, sf_dir):
    return policy.can_write(pairs(spark, sf_dir), "upsert").select("sub", "slug", "can_write")


@query("ui_visible", with_fixtures(f"SELECT sub, slug, status = 'published' OR list_contains(groups, 'admin') OR list_contains(groups, owner_team) AS visible {_PAIRS}", IDENTITIES, SOURCES))
def ui_visible(spark, sf_dir):
    return policy.ui_visible(pairs(spark, sf_dir)).select("sub", "slug", "visible")


SCOPES = Fixture(
    "asked_scopes",
    "id int, kind string, requested array<string>, allowed array<string>, known array<string>",
    [
        (0, "user", [], ["read", "admin.write"], ["read", "admin.write", "x"]),
        (1, "agent", [], ["read", "admin.write"], ["read", "admin.write", "x"]),
        (2, "agent", ["admin.write"], ["read", "admin.write"], ["read", "admin.write", "x"]),
        (3, "user", ["nope"], ["read"], ["read", "x"]),
        (4, "client", ["read", "read"], ["read", "x"], ["read", "x"]),
        (5, "user", ["x"], ["read"], ["read", "x"]),
    ],
).over("customer", "c_custkey", id="CAST(c_custkey AS INT)")


@query("scope_resolve", with_fixtures("""SELECT id, array_to_string(CASE WHEN error IS NOT NULL THEN [] WHEN len(requested) = 0 THEN list_sort(may) ELSE list_sort(list_distinct(requested)) END, ',') AS granted, error FROM (
SELECT *, CASE WHEN len(requested) = 0 THEN NULL WHEN len(list_filter(requested, lambda x: NOT list_contains(known, x))) > 0 THEN 'unknown scope' WHEN len(list_filter(requested, lambda x: NOT list_contains(may, x))) > 0 THEN 'scope not allowed' END AS error FROM (
SELECT *, CASE WHEN kind IN ('agent', 'service') THEN list_filter(allowed, lambda x: x <> 'admin.write') ELSE allowed END AS may FROM asked_scopes))""", SCOPES))
def scope_resolve(spark, sf_dir):
    return policy.resolve_scopes(SCOPES.frame(spark, sf_dir)).select("id", F.array_join("granted", ",").alias("granted"), "error")


def _tokens() -> list[tuple[int, str]]:
    """Tokens with one thing changed in each, and some that are none."""
    import base64
    import json

    enc = lambda d: base64.urlsafe_b64encode(json.dumps(d).encode()).decode().rstrip("=")
    base = {"iss": "me", "aud": ["hub"], "exp": 2000, "nbf": 900, "rh_identity_kind": "user", "sub": "ann", "scope": "b a", "rh_identity_groups": ["g"], "jti": "j", "iat": 5}
    changed = [
        {}, {"iss": "you"}, {"aud": "hub"}, {"aud": "other"}, {"aud": ["x"]}, {"exp": 100}, {"exp": 970}, {"exp": 969}, {"exp": None}, {"exp": "2000"}, {"nbf": 5000}, {"nbf": 1030}, {"nbf": 1031},
        {"rh_identity_kind": "robot"}, {"rh_identity_kind": "agent", "rh_tenant": "t", "rh_request_id": "r", "rh_caller_app": "c"}, {"rh_identity_groups": "g"}, {"rh_identity_groups": None, "scope": None}, {"scope": ["a"]}, {"scope": " x  x y "},
    ]
    rows = [f"{enc({'alg': 'RS256', 'kid': 'k1'})}.{enc(base | c)}.sig" for c in changed]
    rows += [f"{enc({'alg': 'RS256', 'kid': 'k9'})}.{enc(base)}.sig", f"{enc({'alg': 'RS256'})}.{enc(base)}.sig", "nonsense", f"{enc({'kid': 'k1'})}.{enc(base)}", "a.b.c", f"{enc({'kid': 'k1'})}.bm9uZQ.sig"]
    return list(enumerate(rows))


TOKENS = Fixture("tokens", "token_id int, token string", _tokens()).over("customer", "c_custkey", token_id="CAST(c_custkey AS INT)")
_PART = "TRY(CAST(decode(from_base64(rpad(translate(p[{0}], '-_', '+/'), CAST(ceil(length(p[{0}]) / 4.0) * 4 AS INTEGER), '='))) AS JSON))"
_CLAIM = lambda n: f"json_extract_string(j, '$.{n}')"
_KIND_OF = lambda n: f"coalesce(json_type(j, '$.{n}'), 'NULL')"
_WHOLE = lambda n: f"CASE WHEN {_KIND_OF(n)} IN ('UBIGINT', 'BIGINT') THEN CAST({_CLAIM(n)} AS BIGINT) END"
_CLAIMS_ORACLE = f"""SELECT token_id, error, CASE WHEN error IS NULL THEN coalesce({_CLAIM('sub')}, '') END AS subject, CASE WHEN error IS NULL THEN {_CLAIM('rh_identity_kind')} END AS kind,
  CASE WHEN error IS NULL THEN array_to_string(coalesce(CAST(j->'$.rh_identity_groups' AS VARCHAR[]), []), ',') END AS groups,
  CASE WHEN error IS NULL THEN array_to_string(list_sort(list_distinct(list_filter(string_split_regex(coalesce({_CLAIM('scope')}, ''), '\\s+'), lambda x: x <> ''))), ',') END AS scopes,
  CASE WHEN error IS NULL THEN coalesce({_CLAIM('rh_tenant')}, 'default') END AS tenant, CASE WHEN error IS NULL THEN {_CLAIM('rh_request_id')} END AS request_id, CASE WHEN error IS NULL THEN {_CLAIM('rh_caller_app')} END AS caller_app,
  CASE WHEN error IS NULL THEN coalesce({_CLAIM('jti')}, '') END AS jti, CASE WHEN error IS NULL THEN coalesce({_WHOLE('iat')}, 0) END AS issued_at, CASE WHEN error IS NULL THEN {_WHOLE('exp')} END AS expires_at
FROM (SELECT *, CASE WHEN len(p) <> 3 OR json_extract_string(h, '$.kid') IS NULL OR j IS NULL THEN 'malformed' WHEN json_extract_string(h, '$.kid') NOT IN ('k1', 'k2') THEN 'unknown key'
  WHEN coalesce({_CLAIM('iss')}, '') <> 'me' THEN 'issuer'
  WHEN NOT CASE WHEN {_KIND_OF('aud')} = 'ARRAY' THEN list_contains(CAST(j->'$.aud' AS VARCHAR[]), 'hub') ELSE coalesce({_CLAIM('aud')} = 'hub', false) END THEN 'audience'
  WHEN {_WHOLE('exp')} IS NULL THEN 'no expiry' WHEN 1000 > {_WHOLE('exp')} + 30 THEN 'expired' WHEN {_WHOLE('nbf')} > 1030 THEN 'not yet valid'
  WHEN coalesce({_CLAIM('rh_identity_kind')}, '') NOT IN ('user', 'agent', 'service', 'client') THEN 'kind'
  WHEN {_KIND_OF('rh_identity_groups')} NOT IN ('NULL', 'ARRAY') THEN 'groups' WHEN {_KIND_OF('scope')} NOT IN ('NULL', 'VARCHAR') THEN 'scope' END AS error
  FROM (SELECT token_id, p, {_PART.format(1)} AS h, {_PART.format(2)} AS j FROM (SELECT token_id, string_split(token, '.') AS p FROM tokens)))"""


@query("token_claims", with_fixtures(_CLAIMS_ORACLE, TOKENS))
def token_claims(spark, sf_dir):
    return policy.token_claims(TOKENS.frame(spark, sf_dir), "me", "hub", 1000, ["k1", "k2"])


SETS = Fixture("sets", "id int, category string, queried array<string>, expected array<string>", [(0, "a", ["x", "y"], ["x"]), (1, "a", [], []), (2, "b", [], ["x"]), (3, "b", ["x"], []), (4, "b", ["x", "y"], ["y", "x"]), (5, "c", ["x", "x"], ["x", "z"])]).over("orders", "o_orderkey", id="CAST(o_orderkey AS INT)", category="{v} || o_orderstatus")
_PR = """pr AS (SELECT id, category, CASE WHEN n = 0 THEN 1.0 WHEN m = 0 THEN 0.0 ELSE b / n END AS precision, CASE WHEN m = 0 THEN 1.0 ELSE b / m END AS recall, list_sort(list_distinct(queried)) = list_sort(list_distinct(expected)) AS exact
FROM (SELECT *, len(list_distinct(queried)) AS n, len(list_distinct(expected)) AS m, len(list_intersect(list_distinct(queried), list_distinct(expected))) AS b FROM sets))"""


def _pr(spark, sf_dir):
    p, r, e = evaluation.precision_recall(F.col("queried"), F.col("expected"))
    return SETS.frame(spark, sf_dir).select("id", "category", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), e.alias("exact"))


@query("source_precision_recall", with_fixtures(f", {_PR} SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall, exact FROM pr", SETS).replace("\n, pr", ",\npr"))
def source_precision_recall(spark, sf_dir):
    return _pr(spark, sf_dir).drop("category")


@query("category_rollup", with_fixtures(f", {_PR} SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(exact::INT), 6) AS exact FROM pr GROUP BY GROUPING SETS ((), (category))", SETS).replace("\n, pr", ",\npr"))
def category_rollup(spark, sf_dir):
    g = _pr(spark, sf_dir).rollup("category").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in ("precision", "recall", "exact")])
    return g.withColumn("category", F.coalesce("category", F.lit("all")))


CONFIGS = Fixture("configs", "config string, hit_rate double, mrr double, chunks int", [("512/0", 0.95, 0.749, 2098), ("512/64", 0.95, 0.58, 2330), ("256/0", 0.85, 0.692, 4064), ("1024/0", 0.95, 0.749, 1113)]).over("part", "p_partkey", config=tagged("p_partkey"), chunks="{v} + CAST(p_size AS INT)")


@query("sweep_winner", with_fixtures("SELECT * FROM configs ORDER BY hit_rate DESC, mrr DESC, chunks, config LIMIT 1", CONFIGS))
def sweep_winner(spark, sf_dir):
    return evaluation.winner(CONFIGS.frame(spark, sf_dir))


TRUTH = Fixture("truth", "qid int, ids array<string>", [(0, ["0", "1"]), (1, ["5", "99999999"]), (2, ["nope"]), (3, [])])


@query("gt_validation", with_fixtures("SELECT qid, id FROM (SELECT qid, unnest(ids) AS id FROM truth) WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)", TRUTH))
def gt_validation(spark, sf_dir):
    flat = TRUTH.frame(spark, sf_dir).select("qid", F.explode("ids").alias("id"))
    return flat.join(load(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")), "id", "left_anti").select("qid", "id")


@query("eval_history", with_fixtures("SELECT run_id, slug, coalesce(recall_at_5, 0.0) AS recall, row_number() OVER (PARTITION BY slug ORDER BY completed DESC NULLS LAST, run_id) AS position FROM runs WHERE status = 'completed'", RUNS))
def eval_history(spark, sf_dir):
    from pyspark.sql import Window

    done = RUNS.frame(spark, sf_dir).where("status = 'completed'")
    return done.select("run_id", "slug", F.coalesce("recall_at_5", F.lit(0.0)).alias("recall"), F.row_number().over(Window.partitionBy("slug").orderBy(F.desc_nulls_last("completed"), "run_id")).cast("long").alias("position"))


@query("url_map", "SELECT 'n' || n_nationkey || '/' || kind AS key, url FROM (SELECT n_nationkey, 'full' AS kind, 'http://' || n_name AS url FROM nation UNION ALL SELECT n_nationkey, 'pocket', CASE WHEN n_regionkey > 1 THEN 'http://p/' || n_name END FROM nation) WHERE url IS NOT NULL")
def url_map(spark, sf_dir):
    from lodestone.sources.scan import url_map as build

    n = load(spark, sf_dir, "nation")
    return build(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("slug"), F.concat(F.lit("http://"), "n_name").alias("full_url"), F.when(F.col("n_regionkey") > 1, F.concat(F.lit("http://p/"), "n_name")).alias("pocket_url")))


@query("retrieval_patterns", with_fixtures("SELECT slug, pattern, CASE pattern WHEN 'vector_ann' THEN 10 END AS top_k FROM sources, (VALUES ('vector_ann'), ('hybrid')) p(pattern) WHERE family <> 'code'", SOURCES))
def retrieval_patterns(spark, sf_dir):
    names, params = F.array(F.lit("vector_ann"), F.lit("hybrid")), F.create_map(F.lit("vector_ann"), F.lit(10))
    s = SOURCES.frame(spark, sf_dir).where("family <> 'code'")
    return s.select("slug", F.explode(F.transform(names, lambda n: F.struct(n.alias("pattern"), F.try_element_at(params, n).alias("top_k")))).alias("p")).select("slug", "p.*")


@query("usage_rules", with_fixtures("SELECT slug, 'Cite ' || coalesce(nullif(description, ''), name) AS citation FROM sources", SOURCES))
def usage_rules(spark, sf_dir):
    return SOURCES.frame(spark, sf_dir).select("slug", rewrite.interpolate(F.lit("Cite {source}"), {"source": F.coalesce(F.nullif("description", F.lit("")), F.col("name"))}).alias("citation"))


@query("probe_tally", with_fixtures("SELECT sum((status = 'healthy')::INT)::BIGINT AS healthy, sum((status = 'unhealthy')::INT)::BIGINT AS unhealthy, count(*) AS n FROM endpoints", ENDPOINTS))
def probe_tally(spark, sf_dir):
    return ENDPOINTS.frame(spark, sf_dir).agg(F.count_if(F.col("status") == "healthy").alias("healthy"), F.count_if(F.col("status") == "unhealthy").alias("unhealthy"), F.count("*").alias("n"))


@query("scoped_audit", with_fixtures("SELECT event_id FROM events WHERE event_type IN (SELECT CASE owner_team WHEN 'med' THEN 'click' WHEN 'ops' THEN 'error' END FROM sources WHERE status <> 'draft')", SOURCES))
def scoped_audit(spark, sf_dir):
    mine = SOURCES.frame(spark, sf_dir).where("status <> 'draft'").select(F.when(F.col("owner_team") == "med", "click").when(F.col("owner_team") == "ops", "error").alias("event_type"))
    return load(spark, sf_dir, "events").join(F.broadcast(mine), "event_type", "left_semi").select("event_id")
