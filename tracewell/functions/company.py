"""Company records of several shapes as one, their tags, and a cautious canvas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import fold, unfence
from .text import slug

#: Fixed values.
UNKNOWN = "Nao identificado nos dados EaaS"
BLOCKS = ["customer_segments", "value_propositions", "channels", "customer_relationships", "revenue_streams", "key_resources", "key_activities", "key_partners", "cost_structure"]
CHANNELS = ["linkedin", "facebook", "instagram", "tiktok", "pinterest", "youtube", "twitter_x"]
EVIDENCE = ["description", "segment", "estimated_segment", "business_model", "technologies", "employees", "annual_revenue", "is_ecommerce"]
PROMPT_FIELDS = ["name", "domain", "description", "main_cnae", "segment", "estimated_segment", "business_model", "company_size", "employees", "sales_team_size", "annual_revenue", "is_ecommerce", "has_blog", "technologies", "tags", "competitors", "social_media"]
#: Fields of a record that are read, besides the channels.
RAW = [
    "cnpj", "domain", "name", "description", "segment", "estimated_segment", "business_model", "employees", "sales_team_size", "annual_revenue", "estimated_revenue", "is_ecommerce", "has_blog",
    "technologies", "tags", "cb_tags", "competitors", "_warnings", "warnings", "relationship_rd", "relationship_totvs", "updated_at", "enriched_at", "sources_metadata", "twitterX",
    "identity", "digitalPresence", "digital_presence", "businessIntelligence", "business_intelligence", "scores", "mopep", "company_size", "crmContext", "crm_context", "receita_federal",
]
CONTAINERS = set("technologies tags cb_tags competitors _warnings warnings identity digitalPresence digital_presence businessIntelligence business_intelligence scores mopep company_size crmContext crm_context receita_federal sources_metadata".split())
#: Marks of an object and of a list, and the types that show whether a VARIANT is one.
OBJECT, LIST = ("{", "map<string,variant>"), ("[", "array<variant>")


def bind(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# The functions below write SQL: a record has some 60 fields, and a call for each part of each column would take longer than the rows.


def at(value: str, *keys: str) -> list[str] | str:
    found = [f"try_variant_get({value}, '$.{k}', 'variant')" for k in keys]
    return found if len(keys) > 1 else found[0]


def shown(value: str, kind: str) -> str:
    """A value as another type; one that a path gives is taken so at once."""
    if value.endswith(", 'variant')"):
        return f"{value.removesuffix("'variant')")}'{kind}')"
    return f"try_variant_get({value}, '$', '{kind}')"


def said(value: str) -> str:
    """Text of a value; the fields in __text are text already."""
    return value if value.startswith("__text.") else shown(value, "string")


def folded(text: str) -> str:
    return f"replace(replace(lower({text}), 'ß', 'ss'), 'ς', 'σ')"


def boolean(text: str) -> str:
    low = folded(f"trim({text})")
    return f"CASE WHEN {low} IN ('true', '1', 'yes', 'sim') THEN true WHEN {low} IN ('false', '0', 'no', 'nao', 'não') THEN false END"


def distinct_folded(items: str) -> str:
    """Trimmed items without blanks; of those that differ in case only the first."""
    clean = f"filter(transform({items}, x -> trim(x)), x -> x IS NOT NULL AND x <> '')"
    return f"transform(array({clean}), c -> transform(array(transform(c, y -> {folded('y')})), low -> filter(c, (x, i) -> array_position(low, {folded('x')}) = i + 1))[0])[0]"


def filled(text: str) -> str:
    return f"CASE WHEN coalesce(trim({text}), '') NOT IN ('', '[]', '{{}}') THEN {text} END"


def either(*values: str) -> str:
    """Text of the first that isn't empty, zero or false, or else of the last as far as it isn't empty."""
    true = [f"CASE WHEN lower(trim({said(v)})) NOT IN ('0', '0.0', 'false') THEN {filled(said(v))} END" for v in values[:-1]]
    return f"coalesce({', '.join([*true, filled(said(values[-1]))])})"


def reread(text: str) -> str:
    """A text as VARIANT: JSON, or a Python literal, which has single quotes and names of its own."""
    literal = text
    for word, to in (("None", "null"), ("None", "null"), ("True", "true"), ("False", "false")):
        literal = rf"regexp_replace({literal}, '([\\[,:{{]\\s*){word}(?=\\s*[,\\]}}])', '$1{to}')"
    return f"coalesce(try_parse_json({text}), from_json({literal}, 'variant'))"


def container(value: str, kind: tuple[str, str]) -> str:
    """An object, or a list, of a VARIANT: as it is, or parsed where it is held as text; null if it is neither."""
    mark, shape = kind
    text = f"trim({said(value)})"
    return f"CASE WHEN {shown(value, shape)} IS NOT NULL THEN {value} WHEN startswith({text}, '{mark}') THEN {reread(text)} END"


def opened(*values: str) -> str:
    """The first of the objects that has any fields."""
    return f"get(filter(array({', '.join(container(v, OBJECT) for v in values)}), o -> size(try_variant_get(o, '$', 'map<string,variant>')) > 0), 0)"


def listed(*values: str) -> str:
    """All items of several lists one after another; a scalar is a list of one."""
    one = lambda v: f"CASE WHEN {filled(said(v))} IS NULL THEN CAST(array() AS array<string>) ELSE coalesce(try_variant_get({container(v, LIST)}, '$', 'array<string>'), array({said(v)})) END"
    return distinct_folded(f"concat({', '.join(map(one, values))})")


def scalar(text: str) -> str:
    return f"CASE WHEN NOT startswith(ltrim({text}), '[') AND NOT startswith(ltrim({text}), '{{') THEN {text} END"


def company_normalize(df: DataFrame, record: str = "record", name: str = "company") -> DataFrame:
    """df with a struct of the known fields of a JSON record. The record may stand in data.company or company, and may hold
    a payload, whose fields override those around it. Containers may be JSON text or Python literals. Of several places of a
    container the first that has any fields counts, of several places of a field the first with a value in those.

    The record is parsed once, into a VARIANT, from which each field is taken by its path; text that holds a container is
    parsed where it is found. Steps that parse are projections of their own."""
    # Fields that may hold containers stay VARIANT, of which each has all names with it; of the others the text is enough.
    raw = {k: f"{'__raw' if k in CONTAINERS else '__text'}.`{k}`" for k in [*RAW, *CHANNELS]}
    own = lambda k, kind: f"coalesce({shown(at('__payload', k), kind)}, {shown(at('__base', k), kind)}) AS `{k}`"
    own_text = lambda k: f"CASE WHEN {at('__payload', k)} IS NOT NULL THEN {said(at('__payload', k))} ELSE {said(at('__base', k))} END AS `{k}`"
    either_key = lambda v, *keys: opened(*at(v, *keys))
    steps = [
        {"__outer": f"transform(array({reread(f'trim(`{record}`)')}), o -> CASE WHEN try_variant_get(o, '$', 'map<string,variant>') IS NOT NULL THEN o END)[0]"},
        {"__data": container(at("__outer", "data"), OBJECT)},
        {"__company": opened(at("__data", "company"), at("__outer", "company"))},
        {"__payload": opened(at("__outer", "payload"), at("coalesce(__company, __outer)", "payload"))},
        {"__base": "CASE WHEN __payload IS NOT NULL THEN __outer ELSE coalesce(__company, __outer) END"},
        {"__raw": f"struct({', '.join(own(k, 'variant') for k in raw if k in CONTAINERS)})", "__text": f"struct({', '.join(own_text(k) for k in raw if k not in CONTAINERS)})"},
        {
            "__identity": container(raw["identity"], OBJECT),
            "__digital": opened(raw["digitalPresence"], raw["digital_presence"]),
            "__business": opened(raw["businessIntelligence"], raw["business_intelligence"]),
            "__scores": container(raw["scores"], OBJECT),
            "__crm": opened(raw["crmContext"], raw["crm_context"]),
        },
        {
            "__details": either_key("__digital", "domainDetails", "domain_details"),
            "__social": either_key("__digital", "socialMedia", "social_media"),
            "__estimated": container(at("__business", "estimated"), OBJECT),
            "__mopep": opened(raw["mopep"], at("__scores", "mopep")),
            "__porte": opened(raw["company_size"], at("__scores", "porte")),
            "__receita": opened(raw["receita_federal"], *at("__identity", "receitaFederal", "receita_federal")),
        },
    ]
    out = df
    for step in steps:
        out = out.selectExpr("*", *[f"{sql} AS {n}" for n, sql in step.items()])
    estimated_segment = either(raw["estimated_segment"], at("__estimated", "segment"))
    first = lambda *keys: f"coalesce({', '.join(filled(said(raw[k])) for k in keys)})"
    revenue = f"CASE WHEN lower(trim({first('annual_revenue', 'estimated_revenue')})) NOT IN ('0', '0.0', 'false') THEN {first('annual_revenue', 'estimated_revenue')} END"
    fields = {
        "cnpj": filled(said(raw["cnpj"])),
        "domain": filled(said(raw["domain"])),
        "name": either(raw["name"], at("__identity", "name")),
        "description": either(raw["description"], at("__identity", "description")),
        "main_cnae": either(*at("__receita", "main_cnae", "mainCnae", "cnae_principal")),
        "segment": either(raw["segment"], at("__business", "segment")),
        "estimated_segment": estimated_segment,
        "business_model": either(raw["business_model"], *at("__mopep", "business_model", "businessModel")),
        "company_size": either(*at("__porte", "company_size_category", "category")),
        "employees": either(raw["employees"], at("__business", "employees"), at("__estimated", "employees")),
        "sales_team_size": either(raw["sales_team_size"], at("__business", "salesTeamSize")),
        "annual_revenue": f"coalesce({revenue}, {either(*at('__estimated', 'annualRevenue', 'annual_revenue'))})",
        "relationship_rd": either(raw["relationship_rd"], at("__crm", "relationshipRd")),
        "relationship_totvs": either(raw["relationship_totvs"], at("__crm", "relationshipTotvs")),
        "updated_at": first("updated_at", "enriched_at"),
    }
    social = {c: either(raw[c], at("__social", c)) for c in CHANNELS[:-1]}
    own_channel = f"CASE WHEN lower(trim({first('twitter_x', 'twitterX')})) NOT IN ('0', '0.0', 'false') THEN {first('twitter_x', 'twitterX')} END"
    social["twitter_x"] = f"coalesce({own_channel}, {either(*at('__social', 'twitterX', 'twitter_x'))})"
    known = {
        **{n: scalar(c) for n, c in fields.items()},
        "is_ecommerce": f"coalesce({boolean(said(raw['is_ecommerce']))}, CASE WHEN {folded(estimated_segment)} = 'ecommerce' THEN true END)",
        "has_blog": f"coalesce({boolean(said(raw['has_blog']))}, {boolean(said(at('__details', 'hasBlog')))})",
        "technologies": listed(raw["technologies"], at("__details", "technologies")),
        "tags": listed(raw["tags"], raw["cb_tags"], at("__business", "tags"), *at("__mopep", "company_tags", "companyTags")),
        "competitors": listed(raw["competitors"], at("__business", "competitors")),
        "warnings": listed(raw["_warnings"], raw["warnings"]),
        "sources_metadata": f"CASE WHEN {container(raw['sources_metadata'], OBJECT)} IS NOT NULL THEN {filled(said(raw['sources_metadata']))} END",
        "social_media": f"struct({', '.join(f'{scalar(c)} AS {n}' for n, c in social.items())})",
    }
    out = out.drop(name).selectExpr("*", f"struct({', '.join(f'{c} AS {n}' for n, c in known.items())}) AS `{name}`")
    own = F.trim(F.coalesce(F.col(f"{name}.cnpj"), F.col(f"{name}.domain"), F.col(f"{name}.name"), F.lit("")))
    # A generator of one row keeps the fields from being computed again for each later use.
    return out.select(*[c for c in df.columns if c != name], F.explode(F.array(F.col(name).withField("company_id", own))).alias(name))


def company_tags(c: Column) -> Column:
    """Prefixed slugs of a normalised company in a fixed order, each once."""
    one = lambda prefix, value: bind(slug(value), lambda s: F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit(prefix + ":"), s)))
    single = [("segment", c["segment"]), ("estimated-segment", c["estimated_segment"]), ("business-model", c["business_model"]), ("company-size", c["company_size"]), ("relationship-rd", c["relationship_rd"]), ("relationship-totvs", c["relationship_totvs"]), ("ecommerce", c["is_ecommerce"].cast("string"))]
    head = F.array(*[one(p, v) for p, v in single])
    social = F.array(*[F.when(F.coalesce(c["social_media"][n], F.lit("")) != "", F.concat(F.lit("channel:"), slug(F.lit(n)))) for n in CHANNELS])
    return F.array_distinct(F.array_compact(F.concat(head, F.transform(c["tags"], lambda x: one("eaas", x)), F.transform(c["technologies"], lambda x: one("technology", x)), social)))


def baseline_canvas(c: Column) -> dict[str, Column]:
    """The nine blocks as text by rule, with what is known; guesses are marked, and every row needs review."""
    model = fold(F.coalesce(c["business_model"], F.lit("")))
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    shop, blog = F.coalesce(c["is_ecommerce"], F.lit(False)), F.coalesce(c["has_blog"], F.lit(False))
    segment = F.coalesce(c["segment"], c["estimated_segment"])
    words = fold(F.array_join(c["tags"], " "))
    text = lambda *parts: F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit(UNKNOWN))
    saas = model.contains("saas") | words.contains("saas") | words.contains("subscription")
    audience = (
        F.when(model.contains("b2b") & model.contains("b2c"), "Empresas e consumidores finais (hipotese baseada no modelo B2B/B2C)")
        .when(model.contains("b2b"), "Empresas (hipotese baseada no modelo B2B)")
        .when(model.contains("b2c"), "Consumidores finais (hipotese baseada no modelo B2C)")
        .when(model.contains("marketplace"), "Dois ou mais lados da plataforma (hipotese de marketplace)")
        .when(model != "", F.concat(F.lit("Orientacao comercial: "), c["business_model"], F.lit("; publico-alvo requer validacao")))
    )
    filled = lambda n: F.size(c[n]) > 0 if n == "technologies" else c[n].isNotNull() if n == "is_ecommerce" else has(c[n])
    evidence = F.array_compact(F.array(*[F.when(filled(n), n) for n in EVIDENCE]))
    return {
        "customer_segments": text(audience),
        "value_propositions": F.when(has(c["description"]), F.concat(F.lit("Oferta descrita: "), F.trim(c["description"]), F.lit("; validar valor percebido"))).otherwise(UNKNOWN),
        "channels": text(F.when(has(c["domain"]), F.concat(F.lit("Website: "), c["domain"])), *[F.when(has(c["social_media"][n]), n.replace("_", " ").title()) for n in CHANNELS], F.when(blog, "Blog")),
        "customer_relationships": text(F.when(shop, "Autosservico digital (hipotese)"), F.when(has(c["sales_team_size"]), "Venda assistida (hipotese; ha time de vendas informado)")),
        "revenue_streams": text(F.when(saas, "Assinaturas recorrentes (hipotese)"), F.when(shop, "Venda online (hipotese)"), F.when((model != "") & ~saas & ~shop, F.concat(F.lit("Modelo "), c["business_model"], F.lit("; mecanismo de receita requer validacao")))),
        "key_resources": text(F.when(F.size(c["technologies"]) > 0, F.concat(F.lit("Stack digital: "), F.array_join(c["technologies"], ", "))), F.when(has(c["employees"]), F.concat(F.lit("Equipe: "), c["employees"])), F.when(has(c["domain"]), "Presenca digital propria")),
        "key_activities": text(F.when(has(segment), F.concat(F.lit("Operacao no segmento "), segment, F.lit(" (hipotese)"))), F.when(shop, "Operacao de comercio eletronico (hipotese)"), F.when(blog, "Producao de conteudo (hipotese)")),
        "key_partners": F.lit(UNKNOWN),
        "cost_structure": F.lit(UNKNOWN),
        "bmc_source": F.lit("eaas-baseline"),
        "evidence_coverage": F.round(F.size(evidence) / 8, 2),
        "evidence_fields": F.array_join(evidence, "|"),
        "needs_review": F.lit(True),
    }


def canvas_table(companies: DataFrame, company: str = "company") -> DataFrame:
    c = F.col(company)
    own = [c[n].alias(n) for n in ("company_id", "cnpj", "domain", "name", "segment", "estimated_segment", "business_model")]
    return companies.select(*own, *[v.alias(n) for n, v in baseline_canvas(c).items()], F.array_join(company_tags(c), "|").alias("tags"), c["updated_at"].alias("updated_at"))


def block_coverage(canvas: DataFrame) -> DataFrame:
    """Rows without and with evidence by block."""
    rows = canvas.select(F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.col(b).startswith(UNKNOWN).alias("unknown")) for b in BLOCKS])).alias("b"))
    return rows.groupBy("b.block").agg(F.count_if("b.unknown").alias("unknown_rows"), (100 * (1 - F.avg(F.col("b.unknown").cast("int")))).alias("coverage_pct"))


def evidence_prompt(c: Column) -> Column:
    """JSON of the allow-listed fields; contacts are none of them."""
    return F.to_json(F.struct(*[c[n].alias(n) for n in PROMPT_FIELDS]), {"ignoreNullFields": "false"})


def parse_canvas_response(text: Column) -> Column:
    """struct<canvas, error>: all nine blocks must be there and hold text."""
    schema = "struct<" + ",".join(f"{b}:string" for b in BLOCKS) + ">"
    got = F.from_json(unfence(text), schema)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(got[b], F.lit("")).isin("", "[]", "{}", "false", "0"), b) for b in BLOCKS]))
    bad = ~F.coalesce(F.try_parse_json(unfence(text)).isNotNull() & unfence(text).startswith("{"), F.lit(False))
    error = F.when(bad, "not a JSON object").when(F.size(missing) > 0, F.concat(F.lit("missing blocks: "), F.array_join(missing, ", ")))
    return F.struct(F.when(error.isNull(), got).alias("canvas"), error.alias("error"))
