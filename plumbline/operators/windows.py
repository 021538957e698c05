"""Context-window transforms: windows x conditions as one table.

A window is ``system, query`` (strings) and ``anchors, retrieval, recent`` (string arrays). A
format is a function from these columns and its parameters to new columns; a plan is a literal
list of conditions, evaluated side by side in one projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import strings

# Noise items, markers, headers and closing block of a rendered window.
NOISE_BANK = (
    "[session_summary] Sistema de armazenamento chave-valor (Redis) mantem dados em memoria com TTL e eviccao LRU.",
    "[session_summary] Indexacao GIN no PostgreSQL acelera buscas em arrays e colunas jsonb.",
    "[session_summary] Indice invertido mapeia valores/elementos -> linhas que os contem.",
    "[session_summary] Para resumir, extrair apenas substantivos concretos do texto-fonte.",
    "[session_summary] Cache de prompt reduz custo e latencia em chamadas repetidas a API.",
    "[session_summary] Memcached distribui cache entre nos com hashing consistente.",
)
TEMPORAL_MARKERS = ("ÂNCORA TEMPORAL", "ANCORA TEMPORAL", "Momento atual")
FALSE_DATE = "2019-01-01"
FACT_TEMPLATE = "A reunião é às {valor}."
LAYER_PREFIX = {"system": "[fato do sistema] ", "retrieval": "[memória] ", "recent": "[recente] "}
HEADERS = {
    "anchors": "=== HISTÓRICO ANTERIOR (início da sessão) ===",
    "retrieval": "=== MEMÓRIAS RELEVANTES ===",
    "recent": "=== TURNOS RECENTES ===",
    "query": "=== PERGUNTA ATUAL ===",
}
CLOSING_BLOCK = (
    "Importante: opere com ceticismo honesto, metodo rigoroso e humildade "
    "epistemica. Marque claramente o que voce SABE vs o que esta chutando."
)
LISTS, TEXTS = ("anchors", "retrieval", "recent"), ("system", "query")

Sections = dict[str, Column]


@dataclass(frozen=True)
class Formatted:
    sections: Sections
    format_id: str
    patch: dict[str, Column]


Format = Callable[..., Formatted]


def _empty() -> Column:
    return F.array().cast("array<string>")


def normal_sections(df: DataFrame) -> Sections:
    """Columns with nulls as empty and scalars as one-element arrays."""
    types = dict(df.dtypes)
    out: Sections = {}
    for name in TEXTS:
        out[name] = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in types else F.lit("")
    for name in LISTS:
        if name not in types:
            out[name] = _empty()
        elif types[name].startswith("array"):
            out[name] = F.coalesce(F.col(name), _empty())
        else:
            out[name] = F.when(F.col(name).isNull(), _empty()).otherwise(F.array(F.col(name).cast("string")))
    return out


def neutral(s: Sections) -> Formatted:
    return Formatted(s, "neutra", {"formato": F.lit("neutra"), "distorcao": F.lit("nenhuma")})


def ablate(s: Sections, alvo: str = "retrieval") -> Formatted:
    if alvo not in LISTS:
        raise ValueError(f"ablated section must be one of {LISTS}")
    patch = {"formato": F.lit("ablacao"), "ablated": F.lit(alvo), "itens_removidos": F.size(s[alvo]).cast("string")}
    return Formatted({**s, alvo: _empty()}, f"ablacao_{alvo}", patch)


def place_needle(s: Sections, posicao: str = "meio", needle: str | None = None) -> Formatted:
    """The needle, or the first retrieved item, at the start, middle or end of the retrieval list."""
    if posicao not in ("inicio", "meio", "fim"):
        raise ValueError(f"unknown position {posicao!r}")
    items = s["retrieval"]
    rest = items if needle is not None else F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    item = F.lit(needle) if needle is not None else F.try_element_at(items, F.lit(1))
    size = F.size(rest)
    at = {"inicio": F.lit(0), "meio": F.floor(size / 2).cast("int"), "fim": size}[posicao]
    applied = F.lit(True) if needle is not None else F.size(items) > 0
    placed = F.concat(F.slice(rest, 1, at), F.array(item), F.slice(rest, at + 1, F.greatest(size - at, F.lit(0))))
    patch = {
        "formato": F.lit("lost_in_middle"), "posicao": F.lit(posicao), "aplicado": applied.cast("string"),
        "needle_inserida": F.when(applied, F.lit(str(needle is not None).lower())), "idx": F.when(applied, at.cast("string")),
        "motivo": F.when(~applied, F.lit("retrieval vazio")),
    }
    return Formatted({**s, "retrieval": F.when(applied, placed).otherwise(items)}, f"lost_in_middle_{posicao}", patch)


def add_noise(s: Sections, n: int = 5, ruido: Sequence[str] | None = None) -> Formatted:
    """``n`` irrelevant items on top of the retrieval list, cycling through a bank."""
    if n < 0:
        raise ValueError("n must not be negative")
    bank = tuple(ruido) if ruido else NOISE_BANK
    noise = strings([bank[i % len(bank)] for i in range(n)]) if n else _empty()
    patch = {"formato": F.lit("ruido_dominante"), "n_ruido": F.lit(str(n)), "ruido_custom": F.lit(str(ruido is not None).lower())}
    return Formatted({**s, "retrieval": F.concat(noise, s["retrieval"])}, f"ruido_dominante_n{n}", patch)


def cut_history(s: Sections, manter: int = 1) -> Formatted:
    if manter < 0:
        raise ValueError("manter must not be negative")
    removed = F.greatest(F.size(s["recent"]) - manter, F.lit(0))
    patch = {"formato": F.lit("historico_cortado"), "recent_mantidos": F.lit(str(manter)), "recent_removidos": removed.cast("string")}
    return Formatted({**s, "recent": F.slice(s["recent"], 1, manter)}, f"historico_cortado_keep{manter}", patch)


def poison_dates(s: Sections, data_falsa: str = FALSE_DATE) -> Formatted:
    """A false ISO date in the anchors that carry a temporal marker."""
    iso = r"\d{4}-\d{2}-\d{2}"

    def temporal(a: Column) -> Column:
        return F.exists(strings(TEMPORAL_MARKERS), lambda m: F.contains(a, m))

    changed = F.exists(s["anchors"], lambda a: temporal(a) & a.rlike(iso))
    anchors = F.transform(s["anchors"], lambda a: F.when(temporal(a), F.regexp_replace(a, iso, data_falsa)).otherwise(a))
    patch = {
        "formato": F.lit("ancora_envenenada"), "data_falsa": F.lit(data_falsa), "aplicado": changed.cast("string"),
        "motivo": F.when(~changed, F.lit("nenhuma ancora temporal com data ISO")),
    }
    return Formatted({**s, "anchors": anchors}, "ancora_envenenada", patch)


def inject_fact(s: Sections, mapa: Mapping[str, str] | None = None, molde: str = FACT_TEMPLATE) -> Formatted:
    """The same fact, with a value per layer, at the end of system or on top of a list."""
    layers = dict(mapa or {})
    if set(layers) - set(LAYER_PREFIX):
        raise ValueError(f"layers must be among {tuple(LAYER_PREFIX)}")
    out = dict(s)
    for layer, value in layers.items():
        phrase = LAYER_PREFIX[layer] + molde.format(valor=value)
        if layer == "system":
            gap = F.when(out["system"] != "", F.lit("\n")).otherwise(F.lit(""))
            out["system"] = F.concat(out["system"], gap, F.lit(phrase))
        else:
            out[layer] = F.concat(strings([phrase]), out[layer])
    label = ",".join(f"{k}={v}" for k, v in sorted(layers.items())) or "vazio"
    return Formatted(out, f"fato_em_camada({label})", {"formato": F.lit("fato_em_camada"), "mapa": F.lit(label)})


def set_retrieval(s: Sections, itens: Sequence[str] | None = None) -> Formatted:
    items = list(itens or [])
    patch = {"formato": F.lit("lista_retrieval"), "n_itens": F.lit(str(len(items)))}
    return Formatted({**s, "retrieval": strings(items) if items else _empty()}, f"lista_retrieval(n={len(items)})", patch)


FORMATS: dict[str, Format] = {
    "neutra": neutral,
    "ablacao": ablate,
    "lost_in_middle": place_needle,
    "ruido_dominante": add_noise,
    "historico_cortado": cut_history,
    "ancora_envenenada": poison_dates,
    "fato_em_camada": inject_fact,
    "lista_retrieval": set_retrieval,
}


def register_format(name: str, fn: Format) -> None:
    FORMATS[name] = fn


def _as_struct(s: Sections) -> list[Column]:
    return [s[c].alias(c) for c in (*TEXTS, *LISTS)]


def apply_plan(windows: DataFrame, plan: Sequence[Mapping[str, object]]) -> DataFrame:
    """Each window under each condition ``{rotulo, formato, params, papel}`` of a plan.

    Adds ``condition, format_id, role, patch`` and replaces the sections. The plan is unfolded
    inside the projection, so no join is planned and rows stay where they are.
    """
    base = normal_sections(windows)
    rows = []
    for cond in plan:
        name = cond["formato"]
        if name not in FORMATS:
            raise ValueError(f"unknown format {name!r}; known: {sorted(FORMATS)}")
        done = FORMATS[name](base, **(cond.get("params") or {}))
        patch = F.map_filter(F.create_map(*[x for k, v in done.patch.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull())
        rows.append(
            F.struct(
                F.lit(cond["rotulo"]).alias("condition"), F.lit(done.format_id).alias("format_id"), F.lit(cond.get("papel", "")).alias("role"),
                patch.alias("patch"), *_as_struct(done.sections),
            )
        )
    kept = [c for c in windows.columns if c not in (*TEXTS, *LISTS)]
    return windows.select(*kept, F.explode(F.array(*rows)).alias("w")).select(*kept, "w.*")


def build_probe(windows: DataFrame, query: str, retrieval: Sequence[str] = ()) -> DataFrame:
    """Keep system and anchors, set the question and the retrieval list, clear the recent turns."""
    s = normal_sections(windows)
    s |= {"query": F.lit(query), "retrieval": strings(list(retrieval)) if retrieval else _empty(), "recent": _empty()}
    return windows.select(*[c for c in windows.columns if c not in s], *_as_struct(s))


def render(windows: DataFrame, out: str = "prompt", closing: bool = True, closing_text: str = CLOSING_BLOCK) -> DataFrame:
    """The final prompt with fixed headers; empty lists are left out, the closing block is not repeated."""
    s = normal_sections(windows)
    parts = [F.array(s["system"])]
    for name in LISTS:
        parts.append(F.when(F.size(s[name]) > 0, F.concat(strings(["", HEADERS[name]]), s[name])).otherwise(_empty()))
    parts.append(F.concat(strings(["", HEADERS["query"]]), F.array(s["query"])))
    text = F.array_join(F.concat(*parts), "\n")
    if closing and closing_text:
        text = F.when(F.contains(text, F.lit(closing_text)), text).otherwise(F.concat(text, F.lit("\n\n---\n\n" + closing_text)))
    return windows.withColumn(out, text)


def needle_depth(retrieval: str, needle: str) -> Column:
    """0-based depth of the needle in a list, null if it is not there."""
    at = F.array_position(F.coalesce(F.col(retrieval), _empty()), needle)
    return F.when(at > 0, (at - 1).cast("int"))


def count_competitors(retrieval: str, competitors: Sequence[str]) -> Column:
    return F.size(F.filter(F.coalesce(F.col(retrieval), _empty()), lambda x: F.array_contains(strings(competitors), x)))
