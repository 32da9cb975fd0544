"""Sentences that decline: character n-gram naive Bayes over labelled examples and sentences of the data's own replies."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Hashed byte 4-grams, the weight of the background in each class, the most that one gram may say, and the nats from which a sentence declines.
BITS, BACKGROUND, MOST, LEAST = 17, 0.5, 2.5, 6.0
#: A sentence needs so many nats a gram, so that length alone doesn't decide.
EACH = 0.15

#: Labelled examples: sentences that decline, in languages of the data and their neighbours.
DECLINING = """
I can't help with that.
I'm sorry, but I cannot answer this question.
Sorry, I am unable to assist with this request.
I won't be able to respond to that.
I must decline to comment on this.
I'd rather not talk about this topic.
I am not allowed to share that information.
I'm not permitted to discuss this.
I do not have permission to provide that.
I don't feel comfortable answering this.
This request goes against our usage policy.
That violates the content guidelines, so I have to stop here.
It would be inappropriate for me to respond.
This is outside of what I am able to discuss.
My guidelines prevent me from answering.
As an AI language model, I cannot do that.
I refuse to take part in this.
That is something I will not do.
I have to pass on this question.
No comment.
Your request has been denied.
Unfortunately, I'm not in a position to give advice on this.
I'm not willing to continue with this conversation.
This isn't something I can get into.
I regret that I can't fulfil your request.
Please ask someone else, as I can't answer that.
This topic is off limits for me.
I will not provide instructions for this.
We are unable to process this request.
I'll have to say no to that.
I choose not to answer such questions.
I'd prefer to leave this subject alone.
Answering this is not an option for me.
Our rules forbid me to go into this.
This breaks our policy, so I won't do it.
Apologies, I can't go any further with this.
I have been instructed not to talk about this.
I'm sorry, but that's not something I can share.
Dabei kann ich leider nicht helfen.
Diese Frage kann ich nicht beantworten.
Tut mir leid, aber das darf ich nicht sagen.
Ich möchte mich dazu nicht äußern.
Diese Anfrage muss ich ablehnen.
Das verstößt gegen meine Richtlinien.
Es ist mir nicht erlaubt, darüber zu sprechen.
Dazu gebe ich keine Auskunft.
Hierbei kann ich Sie nicht unterstützen.
Ich bin nicht befugt, diese Information zu teilen.
Kein Kommentar.
Ich lehne es ab, das zu tun.
Dazu nehme ich keine Stellung.
Meine Regeln verbieten mir eine Antwort.
Bedaure, darüber spreche ich nicht.
Darauf werde ich nicht antworten.
Das liegt außerhalb dessen, was ich besprechen darf.
Je ne peux pas vous aider avec cela.
Désolé, je ne peux pas répondre à cette question.
Je préfère ne pas en parler.
Je dois refuser cette demande.
Je n’ai pas le droit de traiter cette question.
Il ne m’est pas permis d’en discuter.
Cette demande dépasse ce que je suis autorisé à faire.
Je ne suis pas en mesure de vous donner cette information.
Cela va à l’encontre de mes règles.
Je ne souhaite pas commenter ce sujet.
Pas de commentaire.
Mes règles m’interdisent de répondre.
Je m’abstiens de tout commentaire.
Je regrette, mais je ne traite pas ce genre de demande.
Malheureusement, je ne suis pas autorisé à répondre.
Je refuse de répondre à cela.
No puedo ayudarte con eso.
Lo siento, pero no puedo responder a esta pregunta.
Prefiero no hablar de ese tema.
Debo rechazar esta solicitud.
No me está permitido comentar eso.
No tengo permiso para compartir esa información.
Eso va en contra de mis normas.
No estoy autorizado a dar esa respuesta.
Esta petición está fuera de lo que puedo tratar.
Sin comentarios.
Mis reglas me prohíben responder.
Lo lamento, no se me permite decirlo.
Me abstengo de opinar sobre eso.
Lamentablemente, no me es posible atender tu petición.
Me niego a contestar.
Não posso ajudar com isso.
Desculpe, mas não posso responder a essa pergunta.
Prefiro não falar sobre este assunto.
Tenho de recusar este pedido.
Não tenho permissão para discutir isso.
Não me é permitido comentar.
Isso vai contra as minhas regras.
Não estou autorizado a partilhar essa informação.
Este pedido está fora do que posso tratar.
Sem comentários.
As minhas regras proíbem-me de responder.
Lamento, não me deixam falar sobre isso.
Abstenho-me de opinar sobre isso.
Infelizmente, não me é possível atender ao seu pedido.
Recuso-me a responder.
Nie mogę w tym pomóc.
Przepraszam, ale nie mogę odpowiedzieć na to pytanie.
Wolę o tym nie rozmawiać.
Muszę odmówić tej prośbie.
Nie wolno mi o tym mówić.
Nie mam pozwolenia, aby udostępnić te informacje.
To jest sprzeczne z moimi zasadami.
Nie jestem upoważniony do udzielenia odpowiedzi.
Ta prośba wykracza poza to, co mogę omawiać.
Bez komentarza.
Moje zasady zabraniają mi odpowiadać.
Przykro mi, nie zajmuję się takimi sprawami.
Niestety nie jestem w stanie spełnić tej prośby.
Odmawiam odpowiedzi.
Я не могу с этим помочь.
Извините, но я не могу ответить на этот вопрос.
Я предпочитаю об этом не говорить.
Вынужден отклонить этот запрос.
Мне нельзя это обсуждать.
У меня нет разрешения делиться этой информацией.
Это противоречит моим правилам.
Я не уполномочен давать такой ответ.
Этот запрос выходит за рамки того, что мне разрешено.
Без комментариев.
Мои правила запрещают мне отвечать.
Сожалею, такие темы я не обсуждаю.
К сожалению, я не в состоянии выполнить вашу просьбу.
Отказываюсь отвечать.
Mi dispiace, ma non posso rispondere a questa domanda.
Non posso aiutarti con questo.
Preferisco non parlarne.
Devo rifiutare questa richiesta.
Non sono autorizzato a condividere queste informazioni.
Het spijt me, maar ik kan deze vraag niet beantwoorden.
Daar kan ik niet mee helpen.
Ik wil daar liever niet over praten.
Ik moet dit verzoek weigeren.
Ik mag deze informatie niet delen.
""".strip().splitlines()
#: Labelled examples: sentences that don't decline but speak of those who speak, of what can't be and of rules.
ANSWERING = """
I think the second option is better.
I can help you with that, here is how.
Yes, I would do it the other way round.
I am not sure, but it is probably the cache.
I don't know the exact number.
I have no idea why it fails.
Sorry for the late reply, the job finished an hour ago.
I'm sorry to hear that it crashed again.
You can't open the file while another process holds it.
The server cannot answer more than ten requests at once.
It is not possible to read the table without the index.
The question is answered in the second chapter.
This request takes about two seconds.
My guess is that the loader was restarted.
I would rather use the smaller model here.
You are not allowed to write to this folder, so change the mode first.
Permission denied means that the user lacks the right to read it.
The policy says that logs are kept for thirty days.
We will not need the old index any more.
I can't reproduce it, but here is what I see.
This isn't a bug, it is how the parser works.
No, that does not help.
I do not see an error in your code.
Please restart the worker and try again.
The topic is explained in the manual.
The launcher refuses to start without a manifest.
The server does not respond to the request.
The option is not available in this version.
The rules are applied from top to bottom.
I prefer the shorter answer.
It won't run unless the flag is set.
Never mind, it works now.
Unfortunately the run did not converge.
As a rule, the first step takes longest.
Das kann man mit dem zweiten Befehl beantworten.
Ich kann dir gerne helfen.
Ich weiß es nicht genau.
Leider ist der Lauf abgebrochen.
Das Programm darf nicht ohne Datei starten.
Die Anfrage dauert zwei Sekunden.
Der Server antwortet nicht auf die Anfrage.
Ich lehne mich an das erste Beispiel an.
Ich würde lieber das kleinere Modell nehmen.
Das ist nicht möglich, solange die Datei offen ist.
Je peux vous aider, voici comment faire.
Je ne sais pas exactement.
Malheureusement, le processus s’est arrêté.
On ne peut pas ouvrir le fichier sans la clé.
La demande prend deux secondes.
Le serveur ne répond pas à la requête.
Je préfère le petit modèle pour cela.
La question est traitée dans le deuxième chapitre.
Puedo ayudarte, así se hace.
No sé exactamente cuál es.
Lamentablemente el proceso se detuvo.
No se puede abrir el archivo sin la clave.
La petición tarda dos segundos.
El programa no responde a la solicitud.
Prefiero el modelo pequeño para esto.
Posso ajudar, é assim que se faz.
Não sei exatamente qual é.
Infelizmente o processo parou.
Não se pode abrir o ficheiro sem a chave.
O pedido demora dois segundos.
O programa não responde à solicitação.
Prefiro o modelo pequeno para isto.
Mogę pomóc, robi się to tak.
Nie wiem dokładnie.
Niestety proces się zatrzymał.
Nie można otworzyć pliku bez klucza.
Zapytanie trwa dwie sekundy.
Program nie odpowiada na żądanie.
Wolę do tego mniejszy model.
Я могу помочь, это делается так.
Я точно не знаю.
К сожалению, процесс остановился.
Файл нельзя открыть без ключа.
Запрос занимает две секунды.
Программа не отвечает на команду.
Я предпочитаю для этого маленькую модель.
Posso aiutarti, si fa così.
Non lo so di preciso.
Non si può aprire il file senza la chiave.
Ik kan je helpen, zo doe je dat.
Ik weet het niet precies.
Je kunt het bestand niet openen zonder de sleutel.
""".strip().splitlines()

#: Parts of sentences that decline, a line each: what may stand first | who and how | what is declined | of what. Labelled examples are made of them.
PARTS = """
/Sorry, but /I apologize, but /Unfortunately, /I'm afraid /Apologies, / I can't /I cannot /I can not /I won't /I will not /I shall not /I must not /I may not /I'm not able to /I am unable to /I'm not allowed to /I am not permitted to /I'm not willing to /I would prefer not to /I'd rather not /I don't want to /I do not wish to /I have to decline to /I must refuse to /I decline to /I choose not to /I have been asked not to /I am not authorized to / answer /help with /assist with /discuss /comment on /talk about /speak about /share /respond to /reply to /give an opinion on /go into /get into /say anything about /offer guidance on /advise on /provide details on /provide information about /continue with /engage with /disclose /address /touch on /weigh in on / that /this /this question /this request /this topic /this matter /this subject /such things /things like this /that message /it here
/Sorry, /I apologize, but // I must refrain from /I have to abstain from /I am restricted from /I am prohibited from /I was told to stay away from /I'm not comfortable with /I will stay out of /My guidelines prevent me from /My rules keep me from /Our policy forbids me from /It is not my place to be / answering /helping with /discussing /commenting on /talking about /sharing anything about /responding to /giving details on /giving an opinion on / that /this /this question /this request /this topic /this matter /such things
/Sorry, /Unfortunately, // This request /This question /This topic /That /Your request /Your question /Giving an answer here /Answering this /Doing that / violates /goes against /breaks /is against /would break /would violate /conflicts with /is not allowed by /is outside / my guidelines /our content policy /the rules I follow /our rules /what I can discuss /what I'm allowed to do /my policies /what I am able to help with
/Leider /Es tut mir leid, aber /Tut mir leid, /Bedauerlicherweise // kann ich /darf ich /möchte ich /will ich /werde ich /ich kann /ich darf /ich möchte /ich bin nicht berechtigt, /ich bin nicht befugt, /es ist mir nicht gestattet, /es ist mir nicht erlaubt, /ich lehne es ab, /ich muss ablehnen, / dazu /darauf /dabei /das /darüber /auf solche Anfragen /Ihnen das /Ihre Bitte /diese Frage / nichts sagen /nicht antworten /nicht helfen /nicht beantworten /nicht sprechen /nicht eingehen /keine Auskunft geben /nicht mitteilen /ablehnen /nicht erfüllen /zu antworten /zu beantworten /mich nicht äußern /nicht weitergeben
/Désolé, mais /Je suis désolé, mais /Malheureusement, // je ne peux pas /je ne peux /je ne veux pas /je ne souhaite pas /je ne suis pas autorisé à /je n’ai pas le droit de /je ne suis pas en mesure de /il m’est impossible de /il m’est interdit de /je dois refuser de /je préfère ne pas /je dois décliner /je ne donnerai pas /mes consignes ne me permettent pas de /mes règles m’interdisent de / répondre à /vous aider avec /parler de /discuter de /commenter /traiter /donner un avis sur /partager /donner de réponse à /vous répondre sur / cette question /votre demande /ce sujet /cela /ce point /cette requête
/Lo siento, pero /Lamentablemente, /Me temo que // no puedo /no quiero /no debo /no me es posible /no se me permite /no me está permitido /no estoy autorizado a /no tengo permiso para /no estoy en condiciones de /prefiero no /debo negarme a /me niego a /tengo que rechazar /no me corresponde /mis normas no me permiten /mis reglas me prohíben / responder a /ayudarte con /hablar de /opinar sobre /comentar /tratar /dar una respuesta a /compartir /discutir /contestar / esa pregunta /esta solicitud /ese tema /eso /esta cuestión /esta petición
/Desculpe, mas /Lamento, mas /Infelizmente, /Receio que // não posso /não quero /não devo /não me é possível /não me é permitido /não estou autorizado a /não tenho permissão para /não tenho condições de /prefiro não /devo negar-me a /recuso-me a /tenho de recusar /não me cabe /as minhas normas não me permitem /receio não poder / responder a /ajudar com /falar sobre /opinar sobre /comentar /tratar /dar uma resposta a /partilhar /discutir / essa pergunta /este pedido /esse tema /isso /esta questão /este assunto
/Przepraszam, ale /Przykro mi, ale /Niestety /Obawiam się, że // nie mogę /nie chcę /nie wolno mi /nie mam prawa /nie jestem upoważniony, by /nie jestem w stanie /nie będę /wolę nie /muszę odmówić /odmawiam /moje wytyczne nie pozwalają mi /moje zasady zabraniają mi / odpowiedzieć na /odpowiadać na /pomóc w /mówić o /wypowiadać się na /rozmawiać o /udzielić odpowiedzi na /komentować /omawiać / to pytanie /tę prośbę /ten temat /tym /tej sprawie /tego
/Извините, но /Простите, /К сожалению, /Боюсь, // я не могу /я не хочу /я не буду /мне нельзя /мне не позволено /мне не разрешено /я не вправе /я не имею права /вынужден отказаться /я отказываюсь /предпочту не /мои правила не позволяют мне / отвечать на /ответить на /помочь с /говорить о /высказываться о /обсуждать /комментировать /давать сведения о /дать ответ на / этот вопрос /этот запрос /эту тему /этом /такие темы
/Mi dispiace, ma /Temo che /Purtroppo // non posso /non voglio /non mi è permesso /non sono autorizzato a /preferisco non /devo rifiutare di /le mie regole non mi permettono di /temo di non poter / rispondere a /aiutarti con /parlare di /commentare /condividere / questa domanda /questa richiesta /questo /ciò
/Het spijt me, maar /Helaas /Sorry, maar // kan ik /mag ik /wil ik /ik kan /ik mag /ik wil /ik moet weigeren /mijn regels verbieden mij /ik ben niet bevoegd / u dat /hier /daar /op deze vraag /over dit onderwerp /dit verzoek / niet vertellen /niet over praten /niet op ingaan /niet beantwoorden /niets over zeggen /niet bespreken /niet mee helpen /te antwoorden
""".strip().splitlines()
#: So many sentences are made of each line of PARTS.
MADE = 400


def made() -> list[str]:
    """Sentences put together from PARTS, the same ones in every run."""
    out = []
    for n, line in enumerate(PARTS):
        slots = [x.split("/") for x in line.strip().removeprefix("/").split("/ ")]
        heads = ["", *slots[0]]
        rng = np.random.default_rng(n)
        for _ in range(MADE):
            chosen = [x[rng.integers(len(x))].strip() for x in (heads, *slots[1:])]
            out.append(" ".join(c for c in chosen if c) + ".")
    return out


#: Bytes as they count: digits and marks of ASCII are blanks.
_LETTERS = np.array([k if k >= 128 or k == 10 or chr(k).isalpha() else 32 for k in range(256)], np.uint8)


class RefusalModel:
    """Log-odds of grams. `sentences` are ones of the data's replies that are taken to answer, `declining` ones that are known to decline.

    As some of the former may decline all the same, the model is fitted twice, the second time without those.
    """

    def __init__(self, sentences: list[str] = (), declining: list[str] = ()):
        n_data, n_told = self.count(sentences), self.count(declining)
        self.fit(n_data, n_told)
        if sentences:
            self.fit(n_data - self.count([s for s, x in zip(sentences, self.scores(sentences)) if x >= LEAST]), n_told)

    def fit(self, n_data: np.ndarray, n_told: np.ndarray) -> None:
        """Fit to the examples and to how many of the data's sentences have each gram."""
        n_no, examples = _examples()
        parts = [x / x.sum() for x in (*examples, n_told) if x.any()]
        yes = sum(parts) / len(parts)
        own, data = n_no / max(1.0, n_no.sum()), n_data / max(1.0, n_data.sum())
        no = (own + data) / 2 if n_data.any() else own
        back = (yes + no) / 2 + 1e-6
        odds = np.log(yes + BACKGROUND * back) - np.log(no + BACKGROUND * back)
        self.odds = np.clip(odds, -MOST, MOST).astype(np.float32)

    @staticmethod
    def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all grams of texts of a line each, and where each text's begin; those of a line's last three bytes reach into the next line."""
        data = ("\n".join([" " + t.replace("\n", " ") + " " for t in texts]).lower().replace("’", "'") + "\n").encode("utf_8", "surrogatepass")
        b = _LETTERS[np.frombuffer(data, np.uint8)]
        b = b[~((b == 32) & (np.append(0, b[:-1]) == 32))]  # one blank between words
        b = np.append(b, np.zeros(3, np.uint8)).astype(np.uint32)
        h = b[:-3] * np.uint32(0x9E3779B1) ^ b[1:-2] * np.uint32(0x85EBCA77) ^ b[2:-1] * np.uint32(0xC2B2AE3D) ^ b[3:] * np.uint32(0x27D4EB2F)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        ends = np.flatnonzero(b[:-3] == 10)
        return (h >> np.uint32(32 - BITS)).astype(np.int64), np.concatenate([[0], ends[:-1] + 1])

    @classmethod
    def count(cls, texts: list[str]) -> np.ndarray:
        """How many texts have each gram."""
        out = np.zeros(1 << BITS, np.int64)
        for lo in range(0, len(texts), 5000):
            grams, starts = cls._buckets(texts[lo : lo + 5000])
            size = np.diff(np.append(starts, len(grams)))
            owner = np.repeat(np.arange(len(starts)), size)
            inner = np.arange(len(grams)) < np.repeat(starts + size - 4, size)
            each = np.sort(owner[inner] << BITS | grams[inner])
            out += np.bincount(each[np.diff(each, prepend=-1) != 0] & ((1 << BITS) - 1), minlength=1 << BITS)
        return out

    def scores(self, sentences: list[str]) -> np.ndarray:
        """Nats for declining of each sentence; not above 0 where they aren't many for the sentence's length."""
        out = np.zeros(len(sentences), np.float32)
        for lo in range(0, len(sentences), 5000):
            grams, starts = self._buckets(sentences[lo : lo + 5000])
            odds = self.odds[grams]
            size = np.diff(np.append(starts, len(grams)))
            for k in (1, 2, 3, 4):  # the grams that reach over the line's end count nothing
                odds[np.maximum(starts + size - k, starts)] = 0
            total = np.add.reduceat(odds, starts)
            out[lo : lo + len(starts)] = np.where(total >= EACH * np.maximum(size - 4, 1), total, np.minimum(total, 0))
        return out

    def score(self, sentence: str) -> float:
        return float(self.scores([sentence])[0])

    def declines(self, sentence: str) -> bool:
        return self.score(sentence) >= LEAST


@lru_cache(maxsize=1)
def _examples() -> tuple[np.ndarray, list[np.ndarray]]:
    """The counts of the labelled examples: of those that answer, and of both kinds that decline."""
    return RefusalModel.count(ANSWERING), [RefusalModel.count(DECLINING), RefusalModel.count(made())]
