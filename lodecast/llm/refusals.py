"""Refusals, found by aligning sentences with frames: a self, a negated ability or willingness, and an act of answering.

A frame is a sequence of word classes, not of words. A sentence fits it where words of these classes stand in this order
with no more than GAP other words between two of them. An answer is a refusal where one of its sentences fits a frame of a
refusal, and all that is neither that nor a courtesy is too little to be an answer.
"""

from __future__ import annotations

import re

from lodecast.runtime import ship_by_value

ship_by_value(__name__)

#: Other words that may stand between two words of a frame.
GAP = 6
#: Words, and share of all words, that an answer may have beside refusing and courteous sentences. Of a refusing or courteous sentence these many words are its own.
REST_WORDS, REST_SHARE, OWN_WORDS = 12, 0.35, 24

# Classes of words by language.
CLASSES = {
    "en": {
        "self": "i i'm i'll i'd i've me my myself we we're we'll our us", "not": "not cannot can't won't don't doesn't wouldn't couldn't shouldn't isn't aren't never unable", "no": "no nothing", "something": "something anything way",
        "act": "answer answering answered answers help helping assist assisting assistance comply complying respond responding response provide providing do doing write writing produce producing discuss discussing share sharing fulfil fulfill fulfilling give giving given complete completing create creating engage engaging continue say saying talk talking address addressing participate offer offering generate generating proceed support supporting tell reply replying reproduce make assist go",
        "decline": "decline declining refuse refusing abstain refrain declined refused", "rather": "rather prefer", "skip": "skip pass not decline leave", "rules": "guidelines guideline policy policies rules instructions principles programming restrictions safety", "against": "against violate violates violating prohibit prohibits forbid forbids prevent prevents breach contrary",
        "outside": "outside beyond", "leave": "leave leaving left", "open": "unanswered", "fit": "comfortable appropriate permitted allowed willing able capable position authorised authorized", "ai": "model ai assistant", "be": "will be can shall",
    },
    "de": {
        "self": "ich mir mich mein meine meinen meiner wir uns unsere unseren", "not": "nicht kein keine keinen nichts nie", "act": "helfen beantworten antworten antwort äußern sagen schreiben geben leisten erfüllen behilflich weiterhelfen unterstützen nachkommen tun machen verfassen möglich erlaubt gestattet auskunft eingehen bearbeiten imstande lage dienen",
        "decline": "ablehnen verweigern ablehne verweigere abzulehnen verzichten zurückweisen passen", "rules": "richtlinien regeln vorgaben grundsätze vorschriften", "against": "gegen widerspricht verstößt verbieten untersagen",
    },
    "fr": {
        "self": "je j'ai j'aimerais me m'est m'en moi mon mes ma nous nos notre", "not": "pas ne n'est n'ai jamais rien aucune non impossible", "act": "aider répondre réponse faire écrire fournir satisfaire donner possible accéder traiter mesure autorisé permis dire aborder rédiger assister permet prononcer",
        "decline": "refuser refuse décliner décline abstenir m'abstenir m'abstiens passer", "prefer": "préfère préfère préférerais aimerais", "rules": "règles consignes directives principes", "against": "contraire contre interdisent violerait",
    },
    "es": {
        "may": "puedo posible podemos podré voy quiero deseo debo estoy capaz condiciones permitido permiten me es", "not": "no nunca tampoco imposible", "act": "ayudar ayudarle ayudarte responder hacer hacerlo contestar escribir dar ofrecer cumplir proporcionar comentar atender decir facilitar posible responderé opinar respuesta",
        "must": "tengo debo quiero voy veo prefiero", "decline": "rechazar declinar negarme rehusar abstenerme rechazo declino rehúso", "prefer": "prefiero preferiría", "rules": "normas reglas directrices políticas", "against": "contra contrario prohíben incumple",
    },
    "it": {
        "may": "posso possibile possiamo intendo voglio grado autorizzato sono mi", "not": "non nemmeno impossibile", "act": "aiutarla aiutarti aiutare rispondere farlo fare scrivere fornire dare dire soddisfare possibile esprimermi risposta assisterla",
        "must": "devo voglio preferisco", "decline": "rifiutare declinare rifiutarmi astenermi rifiuto", "prefer": "preferisco preferirei", "rules": "regole linee direttive norme", "against": "contro contrario vietano",
    },
    "pt": {
        "may": "posso possível podemos vou quero devo capaz consigo permitido", "not": "não nunca impossível", "act": "ajudar responder fazer escrever fornecer dar atender dizer oferecer comentar possível resposta", "must": "devo tenho preciso quero",
        "decline": "recusar declinar recuso abster-me abster", "prefer": "prefiro preferiria", "rules": "regras diretrizes normas", "against": "contra contrário proíbem",
    },
    "nl": {
        "self": "ik mij me mijn wij we ons onze", "not": "niet geen nooit niets", "act": "helpen beantwoorden antwoorden antwoord schrijven geven doen zeggen verstrekken voldoen meewerken mogelijk toegestaan", "decline": "weigeren weiger afwijzen passen", "rather": "liever", "rules": "richtlijnen regels beleid", "against": "tegen strijd verbieden",
    },
    "pl": {"not": "nie", "may": "mogę możemy chcę będę jestem można wolno", "act": "pomóc odpowiedzieć odpowiadać zrobić napisać udzielić spełnić powiedzieć stanie", "decline": "odmawiam odmówić"},
    "cs": {"cannot": "nemohu nemůžu nemůžeme nechci nebudu nesmím nedokážu nelze", "act": "pomoci pomoct odpovědět odpovídat udělat napsat poskytnout vyhovět říci říct", "decline": "odmítám odmítnout"},
    "sv": {"self": "jag vi mig", "not": "inte ej inga", "act": "hjälpa svara göra skriva ge besvara säga möjligt bistå", "decline": "avböja avböjer vägrar avstår"},
    "ru": {"not": "не", "may": "могу можем буду хочу стану вправе", "act": "помочь ответить отвечать сделать написать предоставить выполнить сказать обсуждать", "decline": "отказываюсь вынужден отказаться"},
}
FRAMES = {
    "en": "self not act|self not fit|not self act|not something self|no act be act|self no something act|no act self|self decline|self rather skip|rather skip self|self rules not|against self rules|self rules against|outside self act|leave open|not fit self|self not ai act|rules not act",
    "de": "self not act|self decline|not self act|self rules not|against self rules|self rules against|not act self", "fr": "self not act|not self act|self decline|self prefer not|against self rules|self rules against|self not not act|not act self",
    "es": "not may act|must decline|prefer not act|rules not may|against rules|rules against", "it": "not may act|must decline|prefer not act|rules not may|against rules", "pt": "not may act|must decline|prefer not act|rules not may|against rules",
    "nl": "self not act|self decline|self rather not|not self act|against self rules|self rules not", "pl": "not may act|decline", "cs": "cannot act|decline", "sv": "self not act|self decline", "ru": "not may act|decline",
}
# Sentences that answer nothing, by the words they are built around; `*` is any word.
COURTESIES = tuple(
    tuple(x.split())
    for x in (
        "thank you|thanks|sorry|apologise|apologize|apologies|i understand|i hope|i appreciate|you would like to know|feel free|let me know|anything else|something else|someone else|somebody else|please ask|please consult|please contact|please try|ask somebody|different question|other question|"
        "unsafe to say|best to ask|happy to help|glad to help|good luck|have a|take care|you may want|you might|you could ask|kind regards|i wish you|"
        "danke|entschuldigung|es tut mir leid|ich hoffe|bitte fragen|bitte wenden|wenden sie sich|ich verstehe|gerne helfe|merci|désolé|désolée|veuillez demander|veuillez consulter|j'espère|je comprends|n'hésitez|lo siento|gracias|espero|entiendo|consulte a|pregunte a|mi dispiace|grazie|spero|capisco|chieda a|lamento|obrigado|espero que|pergunte a|het spijt|bedankt|vraag het|hm|sadly|regrettably|unfortunately|leider|malheureusement|desgraciadamente|purtroppo|infelizmente|helaas|przykro|przepraszam|bohužel|omlouvám|tyvärr|к сожалению|извините"
    ).split("|")
)

_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"”’»)]*\s+|\n+")
_OF: dict[str, tuple[tuple[str, str], ...]] = {}
for _lang, _classes in CLASSES.items():
    for _name, _list in _classes.items():
        for _w in set(_list.split()):
            _OF[_w] = (*_OF.get(_w, ()), (_lang, _name))
_FRAMES = {k: tuple(tuple(f.split()) for f in v.split("|")) for k, v in FRAMES.items()}
#: Words of which a frame of any language needs one: negations and what declines.
_CORE = frozenset(w for w, at in _OF.items() if any(c in ("not", "no", "decline", "cannot", "rather", "against", "outside", "leave") for _, c in at))
_COURTEOUS: dict[str, tuple[tuple[str, ...], ...]] = {}
for _c in COURTESIES:
    _COURTEOUS[_c[0]] = (*_COURTEOUS.get(_c[0], ()), _c)


def fits(frame: tuple[str, ...], marked: list[tuple[int, set[str]]], gap: int = GAP) -> bool:
    """Whether words of the frame's classes stand in its order, at most gap words apart; marked holds places and classes of the words that have any."""
    ends = [k for k, c in marked if frame[0] in c]
    for name in frame[1:]:
        ends = [k for k, c in marked if name in c and any(0 < k - e <= gap + 1 for e in ends)]
        if not ends:
            return False
    return bool(ends)


def refuses(words: list[str]) -> bool:
    """Whether a sentence fits a frame of a refusal in some language."""
    if _CORE.isdisjoint(words):
        return False
    by_lang: dict[str, list[tuple[int, set[str]]]] = {}
    for k, w in enumerate(words):
        for lang, name in _OF.get(w, ()):
            seen = by_lang.setdefault(lang, [])
            if seen and seen[-1][0] == k:
                seen[-1][1].add(name)
            else:
                seen.append((k, {name}))
    return any(fits(f, marked) for lang, marked in by_lang.items() for f in _FRAMES[lang])


def courteous(words: list[str]) -> bool:
    """Whether a sentence holds a courtesy, or the offer of another source or question."""
    return any(tuple(words[k : k + len(c)]) == c for k, w in enumerate(words) for c in _COURTEOUS.get(w, ()))


def is_refusal(answer: str, split, total: int) -> bool:
    """Whether an answer of `total` words declines and does not answer; split gives the lower-case words of a text.

    Sentences that neither refuse nor are courteous are the answer's rest, together with what goes beyond OWN_WORDS of the
    others. All sentences are looked at, until the rest is too much for a refusal.
    """
    refused, rest, most = False, 0, max(REST_WORDS, REST_SHARE * total)
    for sentence in _SENTENCE.split(answer):
        words = split(sentence)
        if not words:
            continue
        if not refused and refuses(words):
            refused = True
            rest += max(0, len(words) - OWN_WORDS)
        elif courteous(words) or refused and refuses(words):
            rest += max(0, len(words) - OWN_WORDS)
        else:
            rest += len(words)
        if rest > most:
            return False
    return refused
