"""Registered queries of single components: inputs and the outputs they have to give, as tables.

Each table is one query; its SQL is the list of expected outputs, so a component that gives
anything else fails the comparison. Inputs are written as ``input>output`` pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.functions import analysis, dates, geo, lang, numeric, vectors
from searchlake.plans.compiler import small_frame

Rows = list[tuple[str, str, str]]


def pairs(by_name: dict[str, str]) -> Rows:
    return [(name, *(x.strip() for x in pair.split(">", 1))) for name, text in by_name.items() for pair in text.split("|")]


def applied(spark: SparkSession, rows: Rows, call: Callable[[str, str], str]) -> DataFrame:
    """(component, input, output) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(output=[call(c, i) for c, i in zip(f["component"], f["input"], strict=True)])

    return small_frame(spark, [r[:2] for r in rows], "component string, input string").mapInPandas(run, "component string, input string, output string")


def expected(rows: Rows) -> str:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) t(component, input, output)"


STEMS = pairs({
    "stemmer_porter": "caresses>caress|ponies>poni|feed>feed|agreed>agre|motoring>motor|hopping>hop|relational>relat|conditional>condit|triplicate>triplic|adjustment>adjust|controlling>control",
    "stemmer_en_snowball": "enjoy>enjoy|enjoyed>enjoy|enjoyable>enjoy|skies>sky|dying>die|generously>generous|happily>happili",
    "stemmer_en_plural": "boxes>box|ponies>pony|glass>glass|shoes>shoe",
    "stemmer_de_snowball": "abzuschrecken>abzuschreck|abzuwarten>abzuwart|zwirnfabrik>zwirnfabr|zyniker>zynik",
    "stemmer_de_light": "häuser>haus|tische>tisch",
    "stemmer_es_light": "chicana>chican|chicanos>chican|veces>vez",
    "stemmer_it_light": "ragazzo>ragazz|ragazzi>ragazz",
    "stemmer_fr_light": "chevaux>cheval|hiboux>hibou|chanter>chant|baronnes>baron|peaux>peau|anneaux>aneau",
    "stemmer_fr_min": "chevaux>cheval|hiboux>hibou|chantés>chant|baronnes>baron",
    "stemmer_pt_light": "doutores>doutor|homens>homem|normais>normal|lencóis>lencol|barris>barril",
    "stemmer_sv_snowball": "jaktkarlarne>jaktkarl|jaktkarlens>jaktkarl",
    "stemmer_no_snowball": "havnedistriktene>havnedistrikt|havnedistrikter>havnedistrikt",
    "stemmer_da_snowball": "undersøgelse>undersøg|undersøg>undersøg",
    "stemmer_ru_snowball": "актеров>актер|километров>километр|километрах>километр",
    "stemmer_ar": "الحسن>حسن|والحسن>حسن|بالحسن>حسن|للاخر>اخر|زوجها>زوج|ساهدان>ساهد|ساهدون>ساهد|ساهدية>ساهد",
    "stemmer_ckb": "پیاوێک>پیاو|پیاوان>پیاو|پیاوەکان>پیاو|هۆتیلی>هۆتیل|هۆتیلێکی>هۆتیل",
    "stemmer_hi": "लडका>लडक|लडकों>लडक|गुरुओं>गुर|किताबें>किताब|दोस्तों>दोस्त",
    "stemmer_nl_snowball": "lichamelijk>licham|lichamelijke>licham|opgravingen>opgrav",
    "stemmer_es_snowball": "agresivos>agres|agresivamente>agres|agresividad>agres|cheposo>chepos|torneos>torne|checa>chec|checar>chec|checoslovaquia>checoslovaqui|chemise>chemis|cheque>chequ|chequeo>cheque|cheques>chequ|chetumaleños>chetumaleñ|cheyenne>cheyenn|chía>chi|chiapaneca>chiapanec|chiapas>chiap|chicago>chicag|chicas>chic|chicharrones>chicharron|chichimecas>chichimec|chicles>chicl|torá>tor|tórax>torax|torcer>torc|toreado>tor|toreados>tor|toreándolo>tor|torear>tor|toreara>tor|torearlo>tor|toreó>tore|torero>torer|torio>tori|tormenta>torment|tornado>torn|tornen>torn|torneo>torne|tornillo>tornill|torniquete>torniquet|torpedearon>torped|torpeza>torpez|torrencial>torrencial|torrenciales>torrencial|torreón>torreon|torres>torr",
    "stemmer_fr_snowball": "antagoniste>antagon|barbouillait>barbouill|calculateur>calcul|continua>continu|continuait>continu|continuant>continu|continuation>continu|continué>continu|continuel>continuel|continuelle>continuel|continuellement>continuel|continuer>continu|continuera>continu|continuerait>continu|continueront>continu|continuez>continu|continuité>continu|continuons>continuon|contorsions>contors|contournait>contourn|contractée>contract|contractions>contract|contradictoirement>contradictoir|contraindre>contraindr|contraint>contraint|contraires>contrair|contraria>contrari|mains>main|maintenaient>mainten|maintenait>mainten|maintenant>mainten|maintenir>mainten|maintenue>maintenu|maintien>maintien|maire>mair|mairie>mair|maison>maison|maître>maîtr|maîtresse>maîtress|majesté>majest|majestueuse>majestu|majestueusement>majestu|majestueux>majestu|majeure>majeur|majordome>majordom|majorité>major|malacca>malacc|malade>malad|maladie>malad|maladive>malad",
    "stemmer_it_snowball": "aizzata>aizz|aizzargli>aizz|aizzasse>aizz|abbandonando>abbandon|abbandonata>abbandon|abbandonava>abbandon|abbandonerà>abbandon|abbandoneranno>abbandon|abbandono>abband|abbandonò>abbandon|abbaruffato>abbaruff|abbassamento>abbass|abbassando>abbass|abbassandola>abbass|abbassar>abbass|abbassarono>abbass|abbassarsi>abbass|abbassassero>abbass|abbastanza>abbast|abbatté>abbatt|abbattendo>abbatt|abbattere>abbatt|abbattesse>abbattess|abbatteva>abbatt|abbattimento>abbatt|abbattuta>abbatt|abbellita>abbell|abbenché>abbenc|abbi>abbi|pronuncerà>pronunc|pronuncia>pronunc|pronunciamento>pronunc|pronunciarsi>pronunc|pronunziano>pronunz|propagamento>propag|propaganda>propagand|propagarla>propag|propagasse>propag|propagazione>propag|propaghino>propaghin|propende>prop|propensi>propens|propensione>propension|propizio>propiz|propone>propon|proponendosi>propon|proponenti>proponent|proponevano>propon|proponga>propong",
    "stemmer_fi_snowball": "edeltäjiinsä>edeltäj|edeltäjistään>edeltäj",
    "stemmer_hu_snowball": "babakocsi>babakocs|babakocsijáért>babakocs",
})

ANALYZED = pairs({
    "standard": "The Quick-Fox's can't 3.14>quick fox's 3.14",
    "simple": "Ab1Çd>ab çd",
    "keyword": "As it Is>As it Is",
    "web": "at me@x.com #tag @you>me@x.com #tag @you",
    "en": "the walking cats>walk cat|books>book",
    "de": "Tischen>tisch|Schaltflächen>schaltflach|Schaltflaechen>schaltflach|Blechern>blech|Klecks>kleck|Mindestens>mindest|Baldigst>baldig",
    "es": "chicana>chican|yeses>yes|jaeces>jaez|arcos>arc|caos>caos|parecer>parecer",
    "fr": "chien CHAT CHEVAL>chien chat cheval|le la chien les aux chat du des à cheval>chien chat cheval|lances chismes habitable chiste éléments captifs>lanc chism habitabl chist element captif|Jean-François>jean francoi",
    "it": "abbandonata>abbandonat|abbandonati>abbandonat|l'Italiano>italian|Nell'anfora>anfor",
    "pt": "quilométricas>quilometric|quilométricos>quilometric",
    "nl": "lichamelijk>licham|lichamelijke>licham",
    "sv": "jaktkarlarne>jaktkarl|jaktkarlens>jaktkarl",
    "no": "havnedistriktene>havnedistrikt|havnedistrikter>havnedistrikt",
    "da": "undersøg>undersøg|undersøgelse>undersøg",
    "ru": "километрах>километр|актеров>актер|Но знание это хранилось в тайне>знан эт хран тайн",
    "ar": "كبيرة>كبير|مشروبات>مشروب|أمريكيين>امريك|الكتاب>كتاب|ما ملكت أيمانكم>ملكت ايمانكم",
    "fa": "می‌خورد>خورد|خواهد خورد>خورد|خورده‌است>خورده",
    "ckb": "ئەم پیاوە>پیاو|پیاوە>پیاو|پیاو>پیاو",
    "hi": "हिन्दी>हिंद|हिंदी>हिंद",
    "cjk": "こんにちは世界>こん んに にち ちは は世 世界|あいtest>あい test|abc defgh>abc defgh",
    "fi": "edeltäjiinsä>edeltäj|edeltäjistään>edeltäj",
    "hu": "babakocsi>babakocs|babakocsijáért>babakocs",
})

NORMALIZED = pairs({
    "normalize_ar": "آجن>اجن|أحمد>احمد|إعاذ>اعاذ|بنى>بني|فاطمة>فاطمه|روبرـــــت>روبرت|مَبنا>مبنا",
    "normalize_de": "Schaltflächen>Schaltflachen|Schaltflaechen>Schaltflachen|dauer>dauer|weißbier>weissbier",
    "normalize_es": "Guía>Guia|Belcebú>Belcebu|agüero>aguero|laúd>laud",
    "normalize_fa": "های>هاي|کشاندن>كشاندن|زادہ>زاده",
    "normalize_ckb": "ي>ی|ى>ی|ك>ک|ھ>ه|ة>ە|ڒ>ڕ|ررر>ڕرر",
    "normalize_hi": "क़िताब>किताब|अँगरेज़ी>अंगरेजि|फ़र्ज़>फरज",
    "normalize_in": "अाअा>आआ|अाैर>और|त>त",
    "possessive_en": "marty's>marty|MARTY’S>MARTY|s>s|'s>",
    "cjk_width": "Ｔｅｓｔ>Test|ｶﾀｶﾅ>カタカナ|ｳﾞｨｯﾂ>ヴィッツ|ﾊﾟﾅｿﾆｯｸ>パナソニック",
    "cjk_bigram": "こんに>こん んに",
    "elision_fr": "l'avion>avion", "elision_ca": "d'Estudis>Estudis|l'Institut>Institut", "elision_ga": "b'fhearr>fhearr", "elision_it": "dell'Italia>Italia",
})

FILTERS: dict[str, Any] = {
    "length 2 3": analysis.length_filter(2, 3), "truncate 2": analysis.truncate_filter(2), "unique": analysis.unique_filter, "reverse": analysis.reverse_filter,
    "apostrophe": analysis.apostrophe_filter, "camelCase": analysis.camel_case_filter, "dict_compound soft ball": analysis.dict_compound_filter(["soft", "ball"]),
    "ngram 1 2": analysis.ngram_filter(1, 2), "edge_ngram 1 2": analysis.edge_ngram_filter(1, 2), "edge_ngram back 1 2": analysis.edge_ngram_filter(1, 2, True),
    "shingle 2 3": analysis.shingle_filter(2, 3), "hierarchy": analysis.hierarchy_filter("."), "normalize nfkc": analysis.normalize_filter("nfkc"), "stop b": analysis.stop_filter(["b"]), "to_lower": analysis.to_lower,
}
FILTERED = pairs({
    "length 2 3": "a ab abc abcd>ab abc", "truncate 2": "abc é>ab é", "unique": "a b a>a b", "reverse": "abc>cba", "apostrophe": "ali'nin plain>ali plain",
    "camelCase": "camelCase HTMLParser v2>camel Case HTML Parser v 2", "dict_compound soft ball": "softball>softball soft ball", "ngram 1 2": "ab>a ab b",
    "edge_ngram 1 2": "abc>a ab", "edge_ngram back 1 2": "abc>c bc", "shingle 2 3": "a b c>a b b c a b c", "hierarchy": "a.b.c>a a.b a.b.c", "normalize nfkc": "ﬁ>fi",
    "stop b": "a b c>a c", "to_lower": "ABC É>abc é",
})

TOKENIZED = pairs({
    "unicode": "can't stop 3.14, ok?>can't stop 3.14 ok", "letter": "a1b2 çd>a b çd", "whitespace": "a-b  c\td>a-b c d", "single": "One two>One two",
    "web": "see http://x.org/a or #b>see http://x.org/a or #b", "exception": "see http://a.b now>see http://a.b now", "character letter": "ab1cd>ab cd", "regexp [0-9]+": "a12 b3>12 3",
})
TOKENIZERS: dict[str, Any] = {
    "exception": analysis.exception_tokenizer([r"[hH][tT]{2}[pP]://\S*"], analysis.unicode_tokenizer),
    "character letter": analysis.character_tokenizer(r"\p{L}"), "regexp [0-9]+": analysis.regexp_tokenizer("[0-9]+"),
}

CHANGED = pairs({
    "asciifolding": "Ünïcødé ﬁ œuvre ß>Unicode fi oeuvre ss", "zero_width_spaces": "a‌b>a b", "html": "x<b>y</b>z".replace(">", "\u0001") + ">x   y    z", "regexp": "1-2>2/1",
})
CHANGED = [(c, i.replace("\u0001", ">"), o) for c, i, o in CHANGED]

DATES: dict[str, Callable[[str], int | None]] = {
    "optional": dates.optional, "percent": dates.percent_style("%d/%m/%Y %I:%M%p"), "iso": dates.iso_style("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
    "unix_sec": dates.unix(1), "unix_milli": dates.unix(1000), "layout": dates._layout("02 Jan 2006 15:04:05"),
}
DATED = pairs({
    "optional": "2001-09-09T01:46:40Z>1000000000000000000|2001-09-09 03:46:40.5+02:00>1000000000500000000|2001-09-09>999993600000000000|2001-13-01>None",
    "percent": "09/09/2001 1:46AM>999999960000000000", "iso": "2001-09-09T01:46:40.000Z>1000000000000000000", "unix_sec": "1000000000>1000000000000000000|x>None",
    "unix_milli": "1000000000000>1000000000000000000", "layout": "09 Sep 2001 01:46:40>1000000000000000000",
})

NUMBERS: dict[str, Callable[[str], Any]] = {
    "sortable round trip": lambda s: numeric.unsortable(numeric.sortable(float(s))),
    "sortable order": lambda s: " ".join(str(x) for x in sorted(map(float, s.split()), key=numeric.sortable)),
    "prefix coding": lambda s: numeric.decode_prefix(numeric.prefix_code(int(s), 8)),
    "interleave": lambda s: numeric.deinterleave(numeric.interleave(*map(int, s.split()))),
    "ip range": lambda s: " ".join(str(b[-1]) for b in numeric.ip_range(s)),
    "geohash": lambda s: geo.encode_geohash(*map(float, s.split()), 8),
    "geohash decoded": lambda s: " ".join(f"{x:.3f}" for x in geo.decode_geohash(s)),
    "morton": lambda s: " ".join(f"{x:.4f}" for x in geo.unmorton(geo.morton(*map(float, s.split())))),
    "haversine": lambda s: f"{geo.haversine_km(*map(float, s.split())):.3g}",
    "distance": lambda s: f"{geo.distance_metres(s):.1f}",
    "point": lambda s: geo.parse_point(s),
    "base64 vector": lambda s: vectors.decode_base64(s),
}
NUMBERED = pairs({
    "sortable round trip": "-0.5>-0.5|1e+300>1e+300|0.0>0.0", "sortable order": "3 -2 0.5>-2.0 0.5 3.0", "prefix coding": "12345>(12288, 8)|-1>(-256, 8)",
    "interleave": "5 9>5", "ip range": "10.0.0.0/30>0 3", "geohash": "10.40744 57.64911>u4pruydq", "geohash decoded": "u4pruydqqvj>10.407 57.649",
    "morton": "-122.1 37.4>-122.1000 37.4000", "haversine": "-0.1278 51.5074 2.3522 48.8566>343", "distance": "2km>2000.0|1mi>1609.3|3m>3.0", "point": "51.5,-0.1>(-0.1, 51.5)", "base64 vector": "AACAPwAAAEA=>[1.0, 2.0]",
})


def _registry() -> analysis.Registry:
    return analysis.Registry()


def _joined(tokens: Any) -> str:
    return " ".join(t.term for t in tokens)


def stem_words(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, STEMS, lambda name, word: lang.STEMMERS[name](word))


def analyze_samples(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, ANALYZED, lambda name, text: _joined(_registry().analyzer(name).tokens(text)))


def normalize_words(spark: SparkSession, d: str) -> DataFrame:
    def call(name: str, text: str) -> str:
        tokenizer = analysis.unicode_tokenizer if name == "cjk_bigram" else analysis.whitespace_tokenizer
        return _joined(_registry().token_filters[name](tokenizer(text)))

    return applied(spark, NORMALIZED, call)


def filter_samples(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, FILTERED, lambda name, text: _joined(FILTERS[name](analysis.whitespace_tokenizer(text))))


def tokenizer_samples(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, TOKENIZED, lambda name, text: _joined((TOKENIZERS.get(name) or _registry().tokenizers[name])(text)))


def char_filter_samples(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, CHANGED, lambda name, text: (analysis.regexp_filter(r"(\d+)-(\d+)", "$2/$1") if name == "regexp" else _registry().char_filters[name])(text))


def date_samples(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, DATED, lambda name, text: str(DATES[name](text)))


def number_samples(spark: SparkSession, d: str) -> DataFrame:
    return applied(spark, NUMBERED, lambda name, text: str(NUMBERS[name](text)))


def _stop_lists() -> dict[str, frozenset[str]]:
    return {code: frozenset(words) for (kind, code), words in lang._lists().items() if kind == "stop"}


def stop_lists(spark: SparkSession, d: str) -> DataFrame:
    """(code, n): tokens of all documents that each language's stop filter leaves."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term")
    terms = spark.read.parquet(f"{d}/documents.parquet").select(words).groupBy("term").count()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = {n.removeprefix("stop_"): f for n, f in _registry().token_filters.items() if n.startswith("stop_")}
        for f in frames:
            n = dict(zip(f["term"], f["count"], strict=True))
            tokens = [analysis.Token(t, 0, 0, i) for i, t in enumerate(n)]
            yield pd.DataFrame([(code, sum(n[t.term] for t in own(tokens))) for code, own in filters.items()], columns=["code", "n"])

    return terms.mapInPandas(run, "code string, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _stop_sql() -> str:
    lists = _stop_lists()
    values = ", ".join(f"('{code}', '{w.replace(chr(39), chr(39) * 2)}')" for code, words in sorted(lists.items()) for w in sorted(words))
    return f"""WITH stops AS (SELECT * FROM (VALUES {values}) t(code, term)), codes AS (SELECT DISTINCT code FROM stops),
    terms AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM documents) GROUP BY term)
    SELECT code, sum(n)::BIGINT AS n FROM codes, terms WHERE NOT EXISTS (SELECT 1 FROM stops WHERE stops.code = codes.code AND stops.term = terms.term) GROUP BY code"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "stem_words": (stem_words, expected(STEMS)),
    "analyze_samples": (analyze_samples, expected(ANALYZED)),
    "normalize_words": (normalize_words, expected(NORMALIZED)),
    "filter_samples": (filter_samples, expected(FILTERED)),
    "tokenizer_samples": (tokenizer_samples, expected(TOKENIZED)),
    "char_filter_samples": (char_filter_samples, expected(CHANGED)),
    "date_samples": (date_samples, expected(DATED)),
    "number_samples": (number_samples, expected(NUMBERED)),
    "stop_lists": (stop_lists, _stop_sql()),
}
