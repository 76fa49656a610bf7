"""Main language of a text from its scripts and, for Latin letters, from its function words."""

from __future__ import annotations

import re
from collections import Counter


from lodecast.runtime import ship_by_value

ship_by_value(__name__)

# Frequent function words of each language that is written in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and to in a is that was it for on with as by at be this had not are but from or have an they which you were all we when there can more if will would so said what up no out who been one their has her his its than into could should did do does how why please while because until before after about without each some most our your i yet then",
    "de": "der die das und ist in zu den mit von nicht ein eine einen einem einer es sich auf für als auch an werden aus er hat dass sie nach wird bei um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn kann ich du wir ihr wo da was weil wer ohne obwohl dann während unsere manche schon diese dieser am im",
    "fr": "le la les de des du et est un une en que qui dans pour pas au aux sur par plus ce il elle ne se sont avec ou son sa ses mais comme nous vous ils on était été ont cette ces leur même quand sans tout si y avait être je tu mon lui où après avant chaque dit ceux voici là fait bien",
    "es": "el la los las de del y es un una en que por con no para se su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso había ante ellos e cada dice nadie aquí está yo mi vamos hoy dónde qué primero luego antes",
    "it": "il lo la gli le di del della dei delle e è un una uno in che per con non si da al alla ma come più anche questo sono nel nella ha hanno i o se chi dove quando senza era erano prima poi dopo tutto già sul dalla dai volesse soltanto nessuno ogni c'erano",
    "pt": "o os as de do da dos das e é um uma em no na nos nas que por com não para se seu sua ao à como mais mas foi ou quando muito sem já eu também só pelo pela até isso ela entre depois era ele está são tem cada antes quem havia ninguém todo nunca",
    "nl": "de het een en van in is op te dat die niet zijn met voor aan er om ook als dan maar bij nog uit door over naar heeft hij ze was werden wordt toen zonder omdat hoe waar geen tot deze veel wie hun onze had elke nooit alleen",
    "sv": "och att det som en på är av för med till den har de inte om ett men var jag från så vi kan när hade hon eller nu ut där över sig",
    "pl": "i w na z do że się nie jest to o jak po co ale za od dla był przez był przed tym już tylko który są bez gdy",
    "tr": "ve bir bu da de için ile çok daha ne kadar sonra gibi olan olarak her o ki ama değil en var",
}
# The same for further languages. They are asked only where none of the above is found.
FURTHER_WORDS = {
    "cs": "a v na se že je to s z do o i ale jak pro za by si co po k byl jsem od jeho podle nebo které který která jsou bylo již až při tak když jen ještě jako před také však než může byla jsme ve ze není pak kde byly jejich všechny den pod",
    "sk": "a v na sa že je to s z do o i ale ako pre za by si čo po k bol som od jeho podľa alebo ktoré ktorý ktorá sú bolo už až pri tak keď len ešte pred tiež však než môže bola sme nie zo vo kde boli všetky deň pod",
    "fi": "ja on ei että se hän oli mutta joka ovat kun niin myös kuin tai jos sen hänen olla vain jo ole mitä voi sitä tämä ne siitä nyt kanssa mukaan sekä jälkeen ennen kaikki minä sinä tämän tässä siellä olivat eivät sitten vielä",
    "hu": "a az és hogy nem is egy ez meg de csak már volt van mint még ha azt vagy ki el mert kell lehet után minden akkor ezt több nagyon között lesz aki amely voltak ott itt ahol majd",
    "ro": "și în de la cu nu o un că pe se din care este mai pentru a fi au fost sau dar ca după prin lui sunt până când fără între numai această acest ei era unde foarte toate apoi",
    "da": "og i at det er en til på som af med de for den ikke der var et har han men sig fra vi jeg kan hun nu over da skal eller efter blev når mod også hvor alle før",
    "no": "og i det er en til på som av med de for den ikke har var et at han men seg fra vi jeg kan hun nå over da skal eller etter ble når mot også fordi være hvor alle før",
    "id": "yang dan di dengan untuk tidak ini dari dalam itu akan pada juga saya ke ada adalah karena kami mereka bisa atau oleh sudah telah dia kita sebagai tetapi lebih bahwa harus setelah sebelum semua para lagi",
    "vi": "và của là có không một những trong được cho các với người này để đã khi về tôi như đến thì ở nhưng cũng hay rất phải từ ra đó sau trước",
    "hr": "i u je na da se za su od s ne što kao iz ali do po bi koji koja koje nije sam će ili bio bila sve tako još samo kako kad prije nakon zbog bili gdje",
    "sl": "in je na v da se za so z ne ki po pa s od iz ali kot bi do tudi še pri bil bila kako vse le če ker lahko pred bili kjer",
    "lt": "ir yra kad su į iš ne tai bet kaip ar jis buvo o po už nuo dar jau tik labai prie per kai kurie būti jie ant visi prieš",
    "et": "ja on ei et see ta ka kui oli oma aga mis ning või siis veel nii ma selle mille kes pärast enne väga ole olla olid kõik",
    "ca": "el la els les de i a en que és un una per amb no es al del més com però ha són aquest aquesta ja també van hi seva dels quan fins sense molt després abans",
    "sw": "na ya wa kwa ni za katika la kuwa hii si cha yake kama au lakini watu hiyo huo alikuwa baada kabla pia sana kutoka mtu wote",
    "tl": "ang ng sa na ay mga at ni hindi ito para siya ko si may kung isang nang kanyang niya ako ka pa rin lamang din kanilang",
    "sq": "dhe në të e që një për me nuk i është nga si por ka u më janë kjo ky pas para shumë ishte kur",
    "af": "die en van in het is nie wat te dat sy hy met vir op was aan ek hulle ons maar ook sal toe baie na",
}
SCRIPTS = {
    "ja": r"[぀-ヿ]", "ko": r"[가-힣ᄀ-ᇿ]", "zh": r"[一-鿿㐀-䶿]", "ru": r"[Ѐ-ԯ]", "el": r"[Ͱ-Ͽ]",
    "ar": r"[؀-ۿݐ-ݿ]", "he": r"[֐-׿]", "hi": r"[ऀ-ॿ]", "bn": r"[ঀ-৿]", "ta": r"[஀-௿]", "te": r"[ఀ-౿]", "th": r"[฀-๿]",
    "ka": r"[Ⴀ-ჿ]", "hy": r"[԰-֏]", "gu": r"[઀-૿]", "pa": r"[਀-੿]", "kn": r"[ಀ-೿]",
}
#: Letters of one script that a word is counted for in scripts written without spaces.
LETTERS_A_WORD = {"ja": 2, "zh": 2, "th": 4}
# Names of languages, in several languages, by code.
NAMES = {
    "en": "english englisch anglais inglés inglese inglês engels", "de": "german deutsch allemand alemán tedesco alemão duits", "fr": "french französisch français francés francese francês frans",
    "es": "spanish spanisch espagnol español spagnolo espanhol spaans castellano", "it": "italian italienisch italien italiano italiaans", "pt": "portuguese portugiesisch portugais portugués portoghese português portugees",
    "nl": "dutch niederländisch holländisch néerlandais neerlandés olandese holandês nederlands", "sv": "swedish schwedisch suédois sueco", "pl": "polish polnisch polonais polaco", "tr": "turkish türkisch turc turco",
    "ja": "japanese japanisch japonais japonés giapponese japonês", "ko": "korean koreanisch coréen coreano", "zh": "chinese mandarin chinesisch chinois chino cinese chinês", "ru": "russian russisch russe ruso russo",
    "cs": "czech tschechisch tchèque checo ceco", "sk": "slovak slowakisch slovaque eslovaco", "fi": "finnish finnisch finnois finlandés", "hu": "hungarian ungarisch hongrois húngaro", "ro": "romanian rumänisch roumain rumano", "da": "danish dänisch danois danés", "no": "norwegian norwegisch norvégien noruego",
    "id": "indonesian indonesisch indonésien indonesio", "vi": "vietnamese vietnamesisch vietnamien vietnamita", "hr": "croatian serbian bosnian kroatisch serbisch croate serbe croata serbio", "sl": "slovenian slovene slowenisch slovène esloveno", "lt": "lithuanian litauisch lituanien lituano", "et": "estonian estnisch estonien estonio",
    "ca": "catalan katalanisch catalán", "sw": "swahili kiswahili", "tl": "tagalog filipino", "sq": "albanian albanisch albanais albanés", "af": "afrikaans",
    "el": "greek griechisch grec griego greco grego", "ar": "arabic arabisch arabe árabe arabo", "he": "hebrew hebräisch hébreu hebreo", "hi": "hindi", "bn": "bengali", "ta": "tamil", "te": "telugu", "th": "thai",
}

_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ALL = Counter(w for s in _SETS.values() for w in s)
#: (language, weight) of each function word: a word of several languages counts for each in part.
_HITS = {w: tuple((k, 1 / n) for k, s in _SETS.items() if w in s) for w, n in _ALL.items()}
_WIDE = {**_SETS, **{k: frozenset(v.split()) for k, v in FURTHER_WORDS.items()}}
#: Letter trigrams of each language's words, blanks around them.
_GRAMS = {k: frozenset(g for w in v for g in (f" {w} "[i : i + 3] for i in range(len(w)))) for k, v in _WIDE.items()}
_SCRIPTS = {k: re.compile(v) for k, v in SCRIPTS.items()}
_NAMED = {n: k for k, v in NAMES.items() for n in v.split()}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_OTHER = re.compile(r"[\u0370-\u1dff\u2e80-\ua7ff\ua800-\ufaff]")


#: The last text whose words, and whose shares, were asked for, and the answers: several operators ask for the same text in turn.
_WORDS_OF: list = [None, None]
_SHARES_OF: list = [None, 0, 0, None]


def letters_only(text: str) -> list[str]:
    if _WORDS_OF[0] is not text:
        _WORDS_OF[:] = text, _WORD.findall(text.lower().replace("’", "'"))
    return _WORDS_OF[1]


def latin_hits(words: list[str]) -> dict[str, float]:
    """Function words among lower-case words, by language."""
    hits: dict[str, float] = {}
    for w, n in Counter(words).items():
        found = _HITS.get(w)
        if found is None and "'" in w:
            found = sum((_HITS.get(x, ()) for x in w.split("'")), ())
        for k, v in found or ():
            hits[k] = hits.get(k, 0) + v * n
    return hits


def word_shares(text: str, words: list[str] | None = None) -> tuple[int, dict[str, float]]:
    """Number of words, and words by language: of other scripts all words, of Latin letters the function words."""
    words = letters_only(text) if words is None else words
    if _SHARES_OF[0] is text and _SHARES_OF[1] == len(words):
        return _SHARES_OF[2], dict(_SHARES_OF[3])
    found: dict[str, float] = {}
    total = float(len(words))
    if _OTHER.search(text):
        total = sum(1.0 for w in words if w[0] < "\u0370")
        for k, p in _SCRIPTS.items():
            n = len(p.findall(text))
            if n:
                found[k] = n / LETTERS_A_WORD.get(k, 5)
                total += found[k]
        if found.get("ja"):
            found["ja"] += found.pop("zh", 0)
    for k, v in latin_hits(words).items():
        found[k] = found.get(k, 0) + v
    _SHARES_OF[:] = text, len(words), int(total), found
    return int(total), dict(found)


def main_language(text: str | None, least: float = 0.08, words: list[str] | None = None) -> str | None:
    """The language in which a text is mainly written, or None where its words tell of none.

    Of texts in Latin letters it is the language of which most function words are found, if these are at least `least`
    of all words and clearly more than those of any other; where none is, one of the further languages by function words
    and letter trigrams. Words of other scripts count as such.
    """
    if not text:
        return None
    total, found = word_shares(text, [w for w in words if not w[0].isdigit()] if words is not None else None)
    if not total:
        return None
    latin = {k: v for k, v in found.items() if k in _SETS}
    other = {k: v for k, v in found.items() if k not in _SETS}
    foreign = sum(other.values())
    if foreign * 2 > total:
        return max(other, key=lambda k: (other[k], k))
    plain_words = letters_only(text) if words is None else words
    if not latin:
        return further_language(plain_words) if not other else None
    ranked = sorted(latin.items(), key=lambda x: (-x[1], x[0]))
    best, hits = ranked[0]
    rest = total - foreign
    if hits < least * rest or hits < 2 or len(ranked) > 1 and ranked[1][1] > 0.9 * hits:
        return further_language(plain_words)
    # One or two different words may be those of another language.
    if len(_SETS[best].intersection(plain_words)) < 3:
        return further_language(plain_words) or best
    return best


def further_language(words: list[str], least: float = 0.18, margin: float = 1.25) -> str | None:
    """One of FURTHER_WORDS' languages in which lower-case words are mainly written, or None.

    A word counts 1 for a language of whose function words it is, else a third of the share of its letter trigrams that
    stand in that language's function words. The best language must hold at least four different function words, `least` of
    all words, and lead every language of FUNCTION_WORDS by the margin; between further ones the better one wins.
    """
    counts = Counter(w for w in words if not w[0].isdigit())
    total = sum(counts.values())
    if total < 6:
        return None
    likely = []
    for k in FURTHER_WORDS:
        mine = counts.keys() & _WIDE[k]
        if len(mine) >= 4 and sum(counts[w] for w in mine) >= least * total:
            likely.append(k)
    if not likely:
        return None

    def score(k: str) -> float:
        held, grams = _WIDE[k], _GRAMS[k]
        return sum(n if w in held else n / 3 * sum(f" {w} "[i : i + 3] in grams for i in range(len(w))) / len(w) for w, n in counts.items())

    best = max(likely, key=lambda k: (score(k), k))
    return best if score(best) >= margin * max(map(score, _SETS)) else None


def named_languages(text: str | None) -> set[str]:
    """Languages that a text names."""
    return {_NAMED[w] for w in letters_only(text or "") if w in _NAMED}


def function_share(text: str, words: list[str] | None = None) -> float:
    """Share of function words of the best language among all words; 1 for texts mainly in a script other than Latin."""
    total, found = word_shares(text, words)
    if not total:
        return 0.0
    latin = [v for k, v in found.items() if k in _SETS]
    other = sum(v for k, v in found.items() if k not in _SETS)
    return 1.0 if other * 2 > total else max(latin, default=0.0) / max(1.0, total - other)
