"""Refusals by frames: held-out wordings in five languages and more, long ones, and answers that only look like them."""

import pytest

from lodecast.llm import pairs

REFUSALS = """I'd rather skip this one.
Answering that would go against my policies.
I'm not going to be able to answer that.
Sorry, I won't be able to assist you here.
I must respectfully decline to respond.
I can't go into that topic.
That's not something I am willing to discuss.
We are unable to provide an answer to your question.
I do not feel comfortable writing this.
My instructions do not permit me to reply.
It would not be appropriate for me to comment.
This request is beyond what I can support.
I'm afraid I can't do this for you.
I have decided to leave your question unanswered.
I refuse to take part in this.
Dazu kann ich leider keine Auskunft geben.
Ich möchte diese Frage nicht beantworten.
Ich muss das leider ablehnen.
Meine Richtlinien erlauben das nicht.
Das kann ich nicht für Sie schreiben.
Ich darf Ihnen dabei nicht behilflich sein.
Bedauerlicherweise kann ich Ihrem Wunsch nicht nachkommen.
Das verstößt gegen meine Vorgaben.
Ich werde hierzu nichts sagen.
Es ist mir nicht erlaubt, das zu tun.
Je ne suis pas autorisé à traiter cette question.
Je ne souhaite pas répondre.
Je me vois contraint de décliner.
Il ne m'est pas permis de répondre à cela.
Je regrette, je ne peux rien dire à ce sujet.
Cela serait contraire à mes règles.
Je ne vais pas écrire ce texte.
Malheureusement, je ne peux pas donner suite, ni vous aider.
Je préfère ne pas me prononcer.
Je refuse de faire cela.
No voy a responder a esa pregunta.
Prefiero no comentar sobre ese tema.
Debo declinar esta solicitud.
No estoy autorizado a dar esa respuesta.
Lamentablemente no puedo escribir ese texto.
No me es posible atender su petición.
Eso va contra mis normas.
No quiero opinar al respecto, no puedo decir nada.
No podemos ofrecer una respuesta.
Tengo que negarme a ello.
Non posso rispondere a questa domanda.
Devo declinare la richiesta.
Preferisco non rispondere.
Non mi è possibile aiutarla.
Non intendo scrivere questo testo.
Nemohu vám s tím pomoci.
Nie mogę odpowiedzieć na to pytanie.
Não posso responder a isso.
Ik kan deze vraag niet beantwoorden.
Jag kan inte svara på det.""".split("\n")
ANSWERS = """I could not open the old box, so I took it to the mill and asked the men there to lift the lid with a bar.
The guidelines do not mention lamps at all. They speak of doors, of chairs and of the way the hall is kept clean in winter.
I can't recommend the red lamp highly enough. It was moved on Monday by two men who carried it through the garden.
Nobody answered when we knocked, and no help was given to the two men who stood in the rain until the evening.
Ich habe die Lampe nicht gefunden. Sie stand am Montag im Haus am Fluss, danach haben zwei Männer sie in den Garten getragen.
Je ne connais pas la lampe rouge, mais la vieille maison a deux portes et un jardin, et les enfants y jouent le soir.
No vi la lámpara roja en la casa. El lunes dos hombres la llevaron por el jardín hasta la plaza del pueblo.""".split("\n")
Q = "Explain how the red lamp was moved to the old house."


def test_held_out_refusals():
    found = [pairs.defect(Q, a) == "refusal" for a in REFUSALS]
    assert sum(found) >= 0.9 * len(found), [a for a, f in zip(REFUSALS, found, strict=True) if not f]


@pytest.mark.parametrize("answer", ANSWERS)
def test_answers_are_none(answer):
    assert pairs.defect(Q, answer) != "refusal"


def test_length_does_not_matter():
    polite = " ".join(["Thank you very much for asking me about the lamp of the old house."] * 12)
    assert pairs.defect(Q, f"I cannot help with that. {polite}") == "refusal"
    assert pairs.defect(Q, f"{polite} I cannot help with that.") == "refusal"
    told = " ".join(["The lamp was carried by two men from the mill."] * 12)
    assert pairs.defect(Q, f"I cannot help with that. {told}") is None


def test_no_length_limits():
    assert pairs.defect(Q, "[" + " " * 80 + "no answer" + " " * 80 + "]") == "empty"
    long = " ".join(f"word{k} of the old house" for k in range(9)) + "."
    assert pairs.defect(long, " ".join([long] * 7)) == "echo"
    assert pairs.without_mark("The lamp was" + " [...]" * 40) == "The lamp was"


FOREIGN = {
    "cs": "Lampa byla v pondělí přenesena do starého domu, protože muži z města přišli s vozem a podle plánu ji nesli přes zahradu, ale pak už nebylo co dělat.",
    "fi": "Lamppu siirrettiin maanantaina vanhaan taloon, kun kaksi miestä tuli kaupungista, mutta se ei ollut helppoa ja he olivat myös väsyneitä, koska se oli painava.",
    "id": "Lampu itu dipindahkan ke rumah lama pada hari Senin oleh dua orang yang datang dari kota dengan mobil, tetapi mereka tidak tahu bahwa pintu sudah ditutup.",
    "hu": "A lámpát hétfőn vitték át a régi házba, mert két ember jött a városból, és az út nem volt hosszú, de az ajtó már zárva volt, és meg kellett várni, hogy jöjjön valaki.",
    "ro": "Lampa a fost mutată luni în casa veche de doi oameni care au venit din oraș cu o mașină, dar ușa era închisă și nu au putut intra până când a venit cineva.",
    "vi": "Chiếc đèn đã được chuyển đến ngôi nhà cũ vào thứ hai bởi hai người từ thành phố, nhưng cửa đã đóng và không có ai ở đó khi họ đến.",
    "pl": "Lampa została przeniesiona w poniedziałek do starego domu, ale nie było tam nikogo, więc przez cały dzień stała już przed drzwiami i tylko to się wtedy stało.",
}


@pytest.mark.parametrize("lang", sorted(FOREIGN))
def test_answers_in_further_languages(lang):
    assert pairs.defect(Q + " It took five days until the work was done.", FOREIGN[lang]) == "wrong_language"
