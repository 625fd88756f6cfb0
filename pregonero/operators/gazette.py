"""Gazette text -> pages -> blocks -> notices -> canonical rows.

Every step is a column expression over whole texts. Pages are the unit of work: editions are read page by page
(read_pages), so one large edition is shared by many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import classify, dates
from ..functions.jsons import KEEP_NULLS, build, field, merge
from ..functions.places import state_in_text, state_name
from ..functions.text import (
    blank_to_null, capitalise_words, first_filled, grab, grab_first, grab_hinted, is_upper, let, matches_all, normspace,
    strip, title_case, truncate,
)
from ..schema import GAZETTE, conform
from ..sources.files import edition_columns
from . import gazette_patterns as P
from .filters import filter_computed
from .windows import first_per_key

MIN_BLOCK = 100
TITLE_LENGTH, BODY_LENGTH = 500, 1000  # of stored texts


# --- pages -----------------------------------------------------------------------------------------------------

def read_pages(spark: SparkSession, path: str, as_of: Column, glob: str = "*") -> DataFrame:
    """archivo, fecha_ejemplar, edicion_ejemplar, pagina, contenido.

    The page marker is the record separator of the text reader, so Spark splits a file inside and no task holds a
    whole edition. An edition is a file, or a folder archivo=<name> written by the page writer. The record before
    the first marker is dropped; a file without any marker is one page.
    """
    name = F.coalesce(
        grab(F.col("_metadata.file_path"), r"archivo=([^/]+)/"), F.col("_metadata.file_name")
    )
    records = (
        spark.read.option("lineSep", P.PAGE_SEPARATOR)
        .option("pathGlobFilter", glob)
        .text(path)
        .select(
            F.regexp_replace(name, r"\.txt$", "").alias("archivo"), F.col("value").alias("texto"), F.col("_metadata.file_size").alias("bytes")
        )
    )
    headed = F.col("texto").rlike(P.PAGE_HEAD)
    # the one record of a file without marks is as long as the file
    whole = F.octet_length("texto") == F.col("bytes")
    return (
        records.filter(headed | whole)
        .select(
            "archivo",
            F.when(headed, F.regexp_extract("texto", P.PAGE_HEAD, 1).cast("int")).otherwise(1).alias("pagina"),
            F.when(headed, strip(F.regexp_replace("texto", P.PAGE_HEAD, ""))).otherwise(F.col("texto")).alias("contenido"),
        )
        .withColumns(edition_columns(F.col("archivo"), as_of))
    )


def split_pages(texts: DataFrame, text: str = "texto") -> DataFrame:
    """Whole edition texts in a column -> one row per page (`pagina`, `contenido`), other columns kept."""
    marks = matches_all(F.col(text), P.PAGE_MARK, 1)
    parts = F.split(F.col(text), P.PAGE_MARK)
    numbered = F.zip_with(
        marks,
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda n, body: F.struct(n.cast("int").alias("pagina"), strip(body).alias("contenido")),
    )
    single = F.array(F.struct(F.lit(1).alias("pagina"), F.col(text).alias("contenido")))
    keep = [c for c in texts.columns if c != text]
    return texts.select(*keep, F.explode(F.when(F.size(marks) > 0, numbered).otherwise(single)).alias("p")).select(
        *keep, "p.pagina", "p.contenido"
    )


def call_range(pages: DataFrame, loose: bool = False, index_pages: int = P.INDEX_PAGES) -> DataFrame:
    """archivo, inicio, fin: the pages of the calls section.

    From the index on the first pages; else from the section heads in the body; else the whole edition. Page text is
    reduced to small columns before anything is grouped, and these are shuffled once, by edition.
    """
    calls, notices = (P.LOOSE_INDEX_CALLS, P.LOOSE_INDEX_NOTICES) if loose else (P.INDEX_CALLS, P.INDEX_NOTICES)
    text = F.col("contenido")
    early = F.col("pagina") <= index_pages
    marks = pages.select(
        "archivo",
        "pagina",
        F.when(early, grab(text, calls).try_cast("int")).alias("desde"),
        F.when(early, grab(text, notices).try_cast("int")).alias("avisos"),
        text.rlike(P.BODY_CALLS).alias("cuerpo"),
        text.rlike(P.BODY_NOTICES).alias("cierre"),
    ).withColumn("desde_cuerpo", F.min(F.when(F.col("cuerpo"), F.col("pagina"))).over(W.partitionBy("archivo")))
    per_file = marks.groupBy("archivo").agg(
        F.min(F.when(F.col("desde").isNotNull(), F.struct("pagina", "desde", "avisos"))).alias("indice"),
        F.max("pagina").alias("ultima"),
        F.min("desde_cuerpo").alias("cuerpo"),
        F.min(F.when(F.col("cierre") & (F.col("pagina") > F.col("desde_cuerpo")), F.col("pagina"))).alias("cierre"),
    )
    found = F.col("indice").isNotNull()
    return per_file.select(
        "archivo",
        F.when(found, F.col("indice.desde")).otherwise(F.coalesce("cuerpo", F.lit(1))).alias("inicio"),
        F.when(found, F.coalesce(F.col("indice.avisos") - 1, "ultima"))
        .when(F.col("cuerpo").isNotNull(), F.coalesce(F.col("cierre") - 1, "ultima"))
        .otherwise(F.col("ultima"))
        .alias("fin"),
    )


def call_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Only the pages of the calls section."""
    return (
        pages.join(ranges, "archivo").filter(F.col("pagina").between(F.col("inicio"), F.col("fin"))).drop("inicio", "fin")
    )


# --- blocks ----------------------------------------------------------------------------------------------------

def _explode_blocks(pages: DataFrame, blocks: Column, references: Column, minimum: int) -> DataFrame:
    keep = [c for c in pages.columns if c != "contenido"]
    zipped = F.arrays_zip(blocks.alias("texto"), references.alias("referencia"))
    return (
        pages.select(*keep, F.posexplode(zipped).alias("bloque", "b"))
        .select(*keep, "bloque", "b.texto", "b.referencia")
        .filter(F.length(strip(F.col("texto"))) >= minimum)  # the padding of a reference without block is null
    )


def split_blocks(pages: DataFrame, minimum: int = MIN_BLOCK, summary: bool = False) -> DataFrame:
    """Notices of a page, each with the reference that closes it. With `summary`, a page without references is split
    at the summary heads instead."""
    text = F.col("contenido")
    by_reference = F.split(text, P.REFERENCE_END)
    blocks = (
        F.when(F.size(by_reference) > 1, by_reference).otherwise(F.split(text, P.SUMMARY_HEAD)) if summary else by_reference
    )
    return _explode_blocks(pages, blocks, matches_all(text, P.REFERENCE_END, 1), minimum)


def split_blocks_v2(pages: DataFrame, minimum: int = MIN_BLOCK) -> DataFrame:
    """References first; with at most two parts the summary heads, then the agency heads."""
    text = F.col("contenido")
    by_reference = F.split(text, P.REFERENCE_END)
    by_summary = F.split(text, P.SUMMARY_HEAD_2)
    by_agency = F.split(text, P.AGENCY_HEAD)
    blocks = (
        F.when(F.size(by_reference) > 2, by_reference).when(F.size(by_summary) > 2, by_summary).otherwise(by_agency)
    )
    references = F.when(F.size(by_reference) > 2, matches_all(text, P.REFERENCE_END, 1)).otherwise(F.array().cast("array<string>"))
    return _explode_blocks(pages, blocks, references, minimum)


def unique_blocks(blocks: DataFrame, opening: int | None = None) -> DataFrame:
    """Per edition the first of equal blocks; with `opening`, the first of blocks that begin with the same so many
    characters."""
    key = F.sha2("texto", 256) if opening is None else F.substring("texto", 1, opening)
    return first_per_key(blocks.withColumn("_clave", key), ["archivo", "_clave"], ["pagina", "bloque"]).drop("_clave")


# --- notices, first structurer ---------------------------------------------------------------------------------

def number_of(text: Column) -> Column:
    """The full number in capitals without blanks, dashes collapsed."""
    return F.regexp_replace(F.regexp_replace(F.upper(grab(text, P.NUMBER)), r"(?U)\s+", ""), r"-+", "-")


def with_agency(df: DataFrame, head_lines: int = 15) -> DataFrame:
    """dependencia and subdependencia from the first lines."""
    lines = F.slice(F.split("texto", "\n", head_lines + 1), 1, head_lines)
    pairs = F.transform(
        F.col("_lineas"), lambda x, i: F.struct(x.alias("linea"), F.get(F.col("_lineas"), i + 1).alias("siguiente"))
    )
    # only lines that begin like an agency are stripped
    hit = F.get(F.filter(pairs, lambda p: p["linea"].rlike(P.AGENCY_START) & strip(p["linea"]).rlike(P.AGENCY)), F.lit(0))
    after = F.col("_siguiente")
    is_sub = is_upper(after) & (F.length(after) > 10) & ~after.rlike(P.AGENCY)
    return (
        df.withColumn("_lineas", lines)
        .withColumn("_dependencia", hit)
        .withColumns({"dependencia": strip(F.col("_dependencia.linea")), "_siguiente": strip(F.col("_dependencia.siguiente"))})
        .withColumn("subdependencia", F.when(is_sub, after))
        .drop("_lineas", "_dependencia", "_siguiente")
    )


def with_object(df: DataFrame, title_length: int = TITLE_LENGTH, body_length: int = BODY_LENGTH) -> DataFrame:
    """titulo and descripcion from the object label."""
    content = normspace(strip(grab_first(F.col("texto"), P.OBJECT)))
    head = strip(F.regexp_extract("_objeto", rf"(?s)\A(.*?)(?:{P.OBJECT_CUT}|\z)", 1))
    tail = F.regexp_extract("_objeto", rf"(?s)\A.*?((?:{P.OBJECT_CUT}).*)\z", 1)
    joined = strip(F.regexp_replace(tail, rf"(?s)(?<=.)(?={P.OBJECT_CUT})", " "))
    volume = strip(grab(F.col("texto"), P.VOLUME_TAIL))
    return (
        df.withColumn("_objeto", content)
        .withColumn("titulo", blank_to_null(truncate(head, title_length)))
        .withColumn(
            "descripcion",
            F.when(F.col("titulo").isNotNull(), truncate(F.coalesce(blank_to_null(joined), volume), body_length)),
        )
        .drop("_objeto")
    )


def with_location(df: DataFrame) -> DataFrame:
    """State, municipality, locality and address; the last three only where a state is known."""
    text = F.col("texto")
    address = strip(grab_hinted(text, P.ADDRESS))
    usable = let(address, lambda a: F.when((F.length(a) > 10) & (F.length(a) < 300), a))
    known = F.col("entidad_federativa").isNotNull()
    return df.withColumn("entidad_federativa", state_in_text(text)).withColumns(
        {
            "municipio": F.when(known, capitalise_words(grab_hinted(text, P.MUNICIPALITY))),
            "localidad": F.when(known, capitalise_words(grab_hinted(text, P.LOCALITY))),
            "direccion_completa": F.when(known, usable),
        }
    )


def with_events(df: DataFrame) -> DataFrame:
    """The five event dates as timestamps in text; 'No habrá' and 'No aplica' are missing."""
    return df.withColumns({name: dates.event_timestamp(_clock_text(grab(F.col("texto"), p))) for name, p in P.EVENTS.items()})


def _clock_text(c: Column) -> Column:
    """'12/08/2025, a las 10:00' -> '12/08/2025 10:00', so that one date reader serves all forms."""
    clock = r"(?iu)[\s,]+(?:a\s+las?\s+)?(\d{1,2}:\d{2})$"
    return let(c, lambda x: F.when(x.contains(":"), F.regexp_replace(x, clock, " $1")).otherwise(x))


def with_technical(df: DataFrame, specifications_length: int = 500) -> DataFrame:
    """Volume, quantity and unit, specifications and place of the events."""
    text = F.col("texto")
    volume = strip(grab_hinted(text, P.VOLUME))
    place = strip(grab_hinted(text, P.EVENT_PLACE))
    specifications = F.when(text.contains(P.DETAILS_IN_CALL), P.DETAILS_IN_CALL).when(
        F.lower(text).contains("especificaciones"), truncate(strip(grab(text, P.SPECIFICATIONS)), specifications_length)
    )
    return df.withColumn(
        "volumen_obra", let(volume, lambda v: F.when((F.length(v) > 5) & (F.length(v) < 500), v))
    ).withColumns(
        {
            "cantidad": grab(F.col("volumen_obra"), P.QUANTITY, 1),
            "unidad_medida": grab(F.col("volumen_obra"), P.QUANTITY, 2),
            "especificaciones_tecnicas": specifications,
            "lugar_eventos": let(place, lambda p: F.when((F.length(p) > 10) & (F.length(p) < 300), p)),
        }
    )


def _present(*names: str) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])


TECHNICAL = ["volumen_obra", "cantidad", "unidad_medida", "especificaciones_tecnicas", "lugar_eventos"]


def with_confidence(df: DataFrame) -> DataFrame:
    """campos_extraidos and confianza_extraccion: 0.2 for each of number, agency, state; 0.04 for each date and
    technical field, at most ten of them."""
    others = _present(*P.EVENTS, *TECHNICAL)
    critical = _present("numero_licitacion", "dependencia", "entidad_federativa")
    places = F.when(
        F.col("entidad_federativa").isNotNull(),
        _present("entidad_federativa", "municipio", "localidad", "direccion_completa"),
    ).otherwise(0)
    fields = (
        _present("numero_licitacion", "dependencia", "subdependencia", "titulo", "descripcion")
        + 1
        + places
        + others
        + _present("tipo_procedimiento", "caracter_procedimiento", "referencia")
        + 2 * _present("autoridad_reduccion")
    )
    percent = F.least(F.lit(100), critical * 20 + F.least(others, F.lit(10)) * 4)
    return df.withColumns(
        {
            "campos_extraidos": fields,
            "confianza_extraccion": percent / F.lit(100.0),
            "reduccion_plazos": F.col("autoridad_reduccion").isNotNull(),
        }
    )


def is_notice(n: Column) -> Column:
    """A number, or agency and title."""
    return n["numero_licitacion"].isNotNull() | (n["dependencia"].isNotNull() & n["titulo"].isNotNull())


def extract_notices(blocks: DataFrame, raw_length: int = BODY_LENGTH) -> DataFrame:
    """Blocks (texto, referencia and edition columns) -> notices with all extracted fields. The gate comes right after
    the fields it needs, so the other fields are only extracted from notices."""
    text = F.col("texto")
    reference = F.coalesce(grab(text, P.REFERENCE), F.col("referencia"))
    gated = with_object(with_agency(blocks.withColumn("numero_licitacion", number_of(text))))
    df = filter_computed(gated, ["numero_licitacion", "dependencia", "subdependencia", "titulo", "descripcion"], is_notice)
    df = df.withColumns(
        {
            "tipo_contratacion": classify.contract_by_score(text),
            "tipo_procedimiento": grab(text, P.PROCEDURE),
            "caracter_procedimiento": grab(text, P.CHARACTER),
            "referencia": F.concat(F.lit("(R.- "), reference, F.lit(")")),
            "autoridad_reduccion": strip(grab(text, P.REDUCTION)),
        }
    )
    df = with_confidence(with_technical(with_events(with_location(df))))
    return df.withColumns(
        {
            "tipo_procedimiento": F.coalesce("tipo_procedimiento", F.lit("Licitación Pública")),
            "caracter_procedimiento": F.coalesce("caracter_procedimiento", F.lit("Nacional")),
            "raw_text": truncate(text, raw_length),
        }
    ).drop("texto")


def to_canonical(notices: DataFrame, title_length: int = TITLE_LENGTH) -> DataFrame:
    """Notices -> canonical rows with original and specific data as JSON."""
    originals = build(
        **{
            k: F.col(k)
            for k in (
                "fecha_ejemplar", "edicion_ejemplar", "archivo", "pagina", "referencia", "reduccion_plazos",
                "autoridad_reduccion", "fecha_visita_instalaciones", "raw_text",
            )
        }
    )
    specifics = F.to_json(
        F.struct(
            F.col("tipo_contratacion").alias("tipo_contratacion_detectado"),
            *[
                F.col(k)
                for k in (
                    "confianza_extraccion", "campos_extraidos", "volumen_obra", "cantidad", "unidad_medida",
                    "especificaciones_tecnicas", "localidad", "direccion_completa", "lugar_eventos",
                )
            ],
            F.lit(True).alias("procesado_parser_mejorado"),
        ),
        KEEP_NULLS,
    )

    def day(name: str) -> Column:
        return dates.iso_date(dates.date_cut(F.col(name)))

    keep = tuple(c for c in ("archivo", "pagina", "bloque") if c in notices.columns)
    return conform(
        notices.withColumns(
            {
                "numero_procedimiento": F.coalesce("numero_licitacion", F.lit("")),
                "titulo": truncate(F.coalesce("titulo", F.lit("")), title_length),
                "descripcion": F.coalesce("descripcion", F.lit("")),
                "entidad_compradora": F.coalesce("dependencia", F.lit("No especificada")),
                "unidad_compradora": F.col("subdependencia"),
                "estado": F.lit("Publicada"),
                "caracter": F.col("caracter_procedimiento"),
                "fuente": F.lit(GAZETTE),
                "moneda": F.lit("MXN"),
                "fecha_publicacion": day("fecha_publicacion"),
                "fecha_apertura": day("fecha_presentacion_apertura"),
                "fecha_fallo": day("fecha_fallo"),
                "fecha_junta_aclaraciones": day("fecha_junta_aclaraciones"),
                "datos_originales": originals,
                "datos_especificos": specifics,
            }
        ),
        keep=keep,
    )


# --- notices, second structurer --------------------------------------------------------------------------------

def with_object_v2(df: DataFrame) -> DataFrame:
    """titulo and descripcion cut at the next field label; a long object breaks after its first sentence."""
    rest = F.regexp_extract("texto", P.OBJECT_2, 1)
    obj = F.col("_objeto")
    dot = F.instr(obj, ".")
    by_dot = (dot > 1) & (dot <= 200)
    long = F.length(obj) > 200
    title = F.when(long & by_dot, F.substring(obj, F.lit(1), dot - 1)).when(long, F.substring(obj, 1, 200)).otherwise(obj)
    body = F.when(long & by_dot, F.substring(obj, dot + 1, F.length(obj))).when(
        long, F.substring(obj, F.lit(201), F.length(obj))
    )
    unquoted = F.btrim(F.btrim(strip(title), F.lit('"')), F.lit("'"))
    return (
        df.withColumn("_objeto", normspace(F.element_at(F.split(rest, P.OBJECT_END_2, 2), 1)))
        .withColumns({"titulo": blank_to_null(unquoted), "descripcion": blank_to_null(strip(body))})
        .drop("_objeto")
    )


def with_agency_v2(df: DataFrame, agency_lines: int = 15, head_lines: int = 20) -> DataFrame:
    """Agency: first fully capital line of a known kind in the first lines. Sub-agency: first capital line after one."""
    lines = F.transform(F.slice(F.split("texto", "\n", head_lines + 1), 1, head_lines), strip)
    ls = F.col("_lineas")
    agency = F.get(F.filter(F.slice(ls, 1, agency_lines), lambda x: x.rlike(P.AGENCY_2)), F.lit(0))
    at = F.array_position(F.transform(ls, lambda x: x.rlike(P.AGENCY_START_2)), True)
    after = F.slice(ls, at.cast("int") + 1, head_lines)
    sub = F.get(
        F.filter(after, lambda x: x.rlike(P.CAPITALS_2) & (F.length(x) > 10) & ~x.rlike(P.NOT_SUBAGENCY_2)), F.lit(0)
    )
    return (
        df.withColumn("_lineas", lines)
        .withColumns({"dependencia": agency, "subdependencia": F.when(at > 0, sub)})
        .drop("_lineas")
    )


def with_signature(df: DataFrame) -> DataFrame:
    """Place before, and authority after, the closing formula."""
    text = F.col("texto")
    parts = F.col("_partes")
    before, after = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    tail = F.when(F.length(before) > 200, F.right(before, F.lit(200))).otherwise(before)
    lines = F.transform(F.slice(F.split(after, "\n", 6), 1, 5), strip)
    signed = F.size(parts) > 1
    return (
        df.withColumn("_partes", F.split(text, P.SIGNATURE, 2))
        .withColumns(
            {
                "lugar_eventos": F.when(signed, normspace(grab(tail, P.SIGNED_PLACE))),
                "autoridad_firmante": F.when(signed, F.get(F.filter(lines, lambda x: x.rlike(P.SIGNER)), F.lit(0))),
            }
        )
        .drop("_partes")
    )


def extract_notices_v2(blocks: DataFrame) -> DataFrame:
    """Blocks -> notices with nested dates, confidence as the share of five key fields, and the missing ones named.
    Notices below 0.4 are left out."""
    text = F.col("texto")

    def pick(patterns: list[str]) -> Column:
        return blank_to_null(normspace(grab_first(text, patterns)))

    reference = F.col("referencia") if "referencia" in blocks.columns else F.lit(None).cast("string")
    titled = filter_computed(with_object_v2(blocks), ["titulo", "descripcion"], lambda n: n["titulo"].isNotNull())
    df = with_signature(with_agency_v2(titled)).withColumns(
        {
            "numero_licitacion": pick(P.NUMBER_2),
            **{k: pick(p) for k, p in P.FIELDS_2.items() if k != "referencia"},
            "referencia": F.coalesce(pick(P.FIELDS_2["referencia"]), reference),
            **{k: dates.date_parts(pick(p)) for k, p in P.DATES_2.items()},
            "tipo_procedimiento": classify.invitation_detail(text),
            "reduccion_plazos": text.rlike(P.SHORTENED),
            "autoridad_reduccion": F.when(text.rlike(P.SHORTENED), strip(grab(text, P.AUTHORISED_BY))),
            "objeto_contratacion": F.concat_ws(". ", "titulo", "descripcion"),
        }
    )
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in P.KEY_FIELDS_2]))
    total = len(P.KEY_FIELDS_2)
    scored = filter_computed(df.withColumn("campos_faltantes", missing), ["campos_faltantes"], lambda n: F.size(n["campos_faltantes"]) <= 3)
    return scored.withColumn(
        "confianza_extraccion", (F.lit(total) - F.size("campos_faltantes")) / F.lit(float(total))
    ).drop("texto")


# --- older notices ---------------------------------------------------------------------------------------------

def old_notices(texts: DataFrame, text: str = "texto", body_length: int = TITLE_LENGTH) -> DataFrame:
    """Notices found only by their head words, for each of the three kinds. The text is cut at the head words; a piece
    that lacks the word its kind needs runs on into the next, and is no notice if none is left."""
    def of_kind(kind: str, head: str, needed: str) -> Column:
        pieces = F.filter(F.split(F.col(text), f"(?iu)(?={head})"), lambda p: p.rlike(f"(?iu)^{head}"))
        if needed:
            start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

            def add(state: Column, piece: Column) -> Column:
                grown = F.concat(state["open"], piece)
                whole = grown.rlike(f"(?iu){needed}")
                return F.struct(
                    F.when(whole, F.array_append(state["done"], grown)).otherwise(state["done"]).alias("done"),
                    F.when(whole, "").otherwise(grown).alias("open"),
                )

            pieces = F.aggregate(pieces, start, add, lambda state: state["done"])
        return F.transform(pieces, lambda m: F.struct(F.lit(kind).alias("tipo"), m.alias("m")))

    found = F.array(*[of_kind(kind, *words) for kind, words in P.OLD_KINDS.items()])
    keep = [c for c in texts.columns if c != text]
    body = F.col("h.m")
    lines = F.transform(F.slice(F.split(body, "\n", 6), 1, 5), strip)
    titles = F.filter(lines, lambda x: (F.length(x) > 20) & (F.length(x) < 200))
    return texts.select(*keep, F.posexplode(F.flatten(found)).alias("n", "h")).select(
        *keep,
        "n",
        F.coalesce(F.get(titles, F.lit(0)), F.lit("Licitación DOF")).alias("titulo"),
        truncate(body, body_length).alias("descripcion"),
        F.coalesce(grab_first(body, P.OLD_AGENCIES, 0), F.lit("Entidad DOF")).alias("entidad_compradora"),
        F.col("h.tipo").alias("tipo_procedimiento"),
        body.alias("texto_completo"),
    )


# --- stored rows -----------------------------------------------------------------------------------------------

def split_title(title: Column) -> tuple[Column, Column]:
    """(title before the first listed separator it contains, rest from the separator on)."""
    clean, rest = title, F.lit("")
    for sep in reversed(P.TITLE_SEPARATORS):
        at = F.instr(title, sep)
        clean = F.when(at > 0, strip(F.substring(title, F.lit(1), at - 1))).otherwise(clean)
        rest = F.when(at > 0, strip(F.substring(title, at, F.length(title)))).otherwise(rest)
    return clean, rest


def clean_title(title: Column) -> Column:
    """Quotes off; cut at 'Volumen' in a long title, then at the first listed separator."""
    t = F.btrim(title, F.lit("\"'"))
    t = F.when(t.contains("Volumen") & (F.length(t) > 100), strip(F.element_at(F.split(t, "Volumen", 2), 1))).otherwise(t)
    out = t
    for sep in reversed(P.CLEAN_SEPARATORS):
        at = F.instr(t, sep)
        out = F.when(at > 0, strip(F.substring(t, F.lit(1), at - 1))).otherwise(out)
    return strip(out)


def stored_event(text: Column, patterns: list[str]) -> Column:
    """The first pattern whose date is valid; a visit that will not take place is 'No aplica'."""

    def read(v: Column) -> Column:
        return F.when(v.contains("No habrá"), F.lit("No aplica")).otherwise(dates.event_timestamp(_clock_text(v)))

    return F.coalesce(*[let(grab(text, p), read) for p in patterns])


def parse_stored(rows: DataFrame) -> DataFrame:
    """Rows with titulo and descripcion -> the same rows plus the parsed parts and `resultado` as JSON."""
    title = F.coalesce("titulo", F.lit(""))
    description = F.coalesce("descripcion", F.lit(""))
    clean, rest = split_title(title)

    def place(name: str) -> Column:
        value = strip(grab(F.col("_texto"), P.STORED_PLACES[name]))
        return value if name == "direccion" else let(value, lambda v: F.when((F.length(v) > 2) & (F.length(v) < 100), v))

    def volume() -> Column:
        found = [strip(grab(F.col("_texto"), p)) for p in P.STORED_VOLUME]
        return F.coalesce(*[let(v, lambda x: F.when(F.length(x) > 3, truncate(x, 500))) for v in found])

    text = F.col("_texto")
    df = rows.withColumn("_texto", F.concat(title, F.lit(" "), description)).withColumns(
        {
            "titulo_limpio": F.coalesce(blank_to_null(clean), clean_title(title)),
            "descripcion_completa": F.coalesce(blank_to_null(rest), description),
            "fechas_parseadas": F.struct(*[stored_event(text, p).alias(k) for k, p in P.STORED_EVENTS.items()]),
            "ubicacion_extraida": F.struct(*[place(k).alias(k) for k in ("localidad", "municipio", "estado", "ciudad", "direccion")]),
            "info_tecnica": F.struct(
                volume().alias("volumen_obra"),
                grab(text, P.STORED_QUANTITY, 1).alias("cantidad"),
                grab(text, P.STORED_QUANTITY, 2).alias("unidad"),
                F.lit(None).cast("string").alias("especificaciones"),
                F.when(text.rlike(P.STORED_DETAILS), P.DETAILS_IN_CALL).alias("detalles_convocatoria"),
                F.when(text.rlike(P.NO_VISIT), False).when(text.rlike(P.SITE_VISIT), True).alias("visita_requerida"),
                F.when(text.rlike(P.INTERNATIONAL), "Internacional")
                .when(text.rlike(P.NATIONAL), "Nacional")
                .alias("caracter_procedimiento"),
            ),
        }
    )
    at = F.col("ubicacion_extraida")
    df = df.withColumns(
        {
            "entidad_parseada": F.coalesce(state_name(strip(at["estado"])), state_in_text(text)),
            "municipio_parseado": title_case(first_filled(at["municipio"], at["ciudad"], at["localidad"])),
        }
    )
    result = F.struct(
        "titulo_limpio",
        "descripcion_completa",
        F.try_parse_json(F.to_json("fechas_parseadas")).alias("fechas_parseadas"),
        F.try_parse_json(F.to_json("ubicacion_extraida", KEEP_NULLS)).alias("ubicacion_extraida"),
        F.try_parse_json(F.to_json("info_tecnica", KEEP_NULLS)).alias("info_tecnica"),
        F.col("entidad_parseada").alias("entidad_federativa"),
        F.col("municipio_parseado").alias("municipio"),
        F.lit(True).alias("procesado"),
    )
    return df.withColumn("resultado", F.to_json(result, KEEP_NULLS)).drop("_texto")


# --- gazette JSON files ----------------------------------------------------------------------------------------

_FILE = (
    "version_extractor string, fecha_ejemplar string, edicion_ejemplar string, archivo_origen string, "
    "licitaciones array<string>, data array<string>"
)


def file_records(docs: DataFrame) -> DataFrame:
    """Gazette JSON documents -> records: file_name, pos, version, edition columns, rec (variant)."""
    parsed = docs.select("file_name", F.from_json("text", _FILE).alias("e"), F.from_json("text", "array<string>").alias("l"))
    items = F.coalesce("e.licitaciones", "e.data", "l")
    return parsed.select(
        "file_name",
        (F.coalesce("e.version_extractor", F.lit("")) == "2.0").alias("mejorado"),
        "e.fecha_ejemplar",
        "e.edicion_ejemplar",
        "e.archivo_origen",
        F.posexplode(items).alias("pos", "json"),
    ).withColumn("rec", F.try_parse_json("json"))


def _clean_object(c: Column) -> Column:
    """Object text up to the first end label, labels tried in their listed order."""
    out = c
    for pattern in reversed(P.OBJECT_END_V1):
        out = F.when(c.rlike(pattern), strip(F.element_at(F.split(c, pattern, 2), 1))).otherwise(out)
    return out


def normalise_file_records(recs: DataFrame, as_of: Column) -> DataFrame:
    """Records of both file versions -> canonical rows. Number and agency are required."""
    rec = F.col("rec")
    better = F.col("mejorado")
    obj = _clean_object(F.coalesce(field(rec, "objeto_licitacion"), F.lit("")))
    better_title = F.coalesce(
        first_filled(field(rec, "titulo"), field(rec, "objeto_licitacion"), truncate(field(rec, "objeto_contratacion"), 500)),
        F.lit(""),
    )
    number = blank_to_null(field(rec, "numero_licitacion"))

    def day(name: str) -> Column:
        flat = dates.gazette_date(field(rec, name))
        nested = dates.structured_date(field(rec, f"{name}.fecha"), field(rec, f"{name}.texto_original"))
        is_nested = F.schema_of_variant(F.try_variant_get(rec, f"$.{name}", "variant")).startswith("OBJECT")
        return F.when(better & is_nested, nested).otherwise(flat)

    def edition(name: str) -> Column:
        return F.coalesce(first_filled(F.col(name), field(rec, name)), F.lit(""))

    extra = build(
        fecha_ejemplar=edition("fecha_ejemplar"),
        edicion_ejemplar=edition("edicion_ejemplar"),
        archivo_origen=edition("archivo_origen"),
        pagina=F.try_variant_get(rec, "$.pagina", "variant"),
        referencia=field(rec, "referencia"),
        lugar_eventos=field(rec, "lugar_eventos"),
        autoridad_firmante=field(rec, "autoridad_firmante"),
        volumen_adquirir=field(rec, "volumen_adquirir"),
    )
    return conform(
        recs.withColumns({"_objeto": obj, "_titulo": better_title})
        .withColumns(
            {
                "numero_procedimiento": number,
                "titulo": F.when(better, F.col("_titulo")).otherwise(truncate(F.col("_objeto"), 500)),
                "descripcion": F.when(better, field(rec, "descripcion")).when(F.length("_objeto") > 500, F.col("_objeto")),
                "entidad_compradora": blank_to_null(field(rec, "dependencia")),
                "unidad_compradora": F.when(
                    better, first_filled(field(rec, "subdependencia"), field(rec, "unidad_responsable"))
                ).otherwise(field(rec, "subdependencia")),
                "tipo_procedimiento": F.coalesce(
                    F.when(better, first_filled(field(rec, "tipo_procedimiento"))), classify.procedure_from_number(number)
                ),
                "tipo_contratacion": classify.contract_from_text(F.when(better, F.col("_titulo")).otherwise(F.col("_objeto"))),
                "estado": F.lit("VIGENTE"),
                "moneda": F.lit("MXN"),
                "fuente": F.lit(GAZETTE),
                "caracter": classify.stored_character(field(rec, "caracter_licitacion")),
                "fecha_publicacion": F.coalesce(day("fecha_publicacion"), as_of),
                "fecha_junta_aclaraciones": day("fecha_junta_aclaraciones"),
                "fecha_apertura": day("fecha_presentacion_apertura"),
                "fecha_fallo": day("fecha_fallo"),
                "datos_originales": F.when(better, merge(F.to_json("rec"), extra)).otherwise(F.to_json("rec")),
            }
        )
        .filter("numero_procedimiento is not null and entidad_compradora is not null"),
        keep=("file_name", "pos"),
    )


# --- stored model answers --------------------------------------------------------------------------------------

def answer_records(answers: DataFrame, model: str | None = None) -> DataFrame:
    """answers(file, page, answer) -> one row per notice, with the file and page it came from.

    The text from the first '[' to the last ']' is read as a list, after code fences are removed; a single object
    counts as a list of one; text that is no JSON gives no row.
    """
    from_open = F.when(F.instr("answer", "[") > 0, F.substring(F.col("answer"), F.instr("answer", "["), F.length("answer"))).otherwise(
        F.col("answer")
    )
    to_close = F.coalesce(grab(from_open, r"(?s)\A(.*\])"), from_open)
    body = strip(F.regexp_replace(to_close, "```json|```", ""))
    wrapped = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    rec = F.col("rec")
    return (
        answers.select("file", "page", F.posexplode(F.from_json(wrapped, "array<string>")).alias("pos", "json"))
        .withColumn("rec", F.try_parse_json("json"))
        .filter("rec is not null")
        .select(
            "file",
            "page",
            "pos",
            blank_to_null(field(rec, "numero_procedimiento")).alias("numero_procedimiento"),
            *[
                field(rec, k).alias(k)
                for k in (
                    "titulo", "descripcion", "entidad_compradora", "unidad_compradora", "tipo_procedimiento",
                    "tipo_contratacion", "caracter", "entidad_federativa", "municipio", "fecha_publicacion",
                    "fecha_apertura", "fecha_fallo", "fecha_junta_aclaraciones", "referencia",
                )
            ],
            F.lit(GAZETTE).alias("fuente"),
            F.lit("PUBLICADA").alias("estado"),
            F.lit("MXN").alias("moneda"),
            F.to_json(
                F.struct(
                    F.col("file").alias("archivo_origen"),
                    F.lit(True).alias("procesado_con_ia"),
                    F.lit(model).cast("string").alias("modelo"),
                    F.col("page").alias("pagina_dof"),
                )
            ).alias("datos_originales"),
        )
    )


def numbered(notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notices with a number, per file the count of those dropped for lack of one)."""
    has = F.col("numero_procedimiento").isNotNull()
    dropped = notices.groupBy("file").agg(F.count_if(~has).alias("sin_numero"), F.count_if(has).alias("validas"))
    return notices.filter(has), dropped
