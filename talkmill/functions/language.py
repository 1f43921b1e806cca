"""Language identification by rank order of character n-grams (Cavnar and Trenkle).

A profile lists a language's most frequent sequences of one to three characters, most frequent
first; a blank stands at both ends of every word and sequences do not span two words.  A text is ranked the same way,
and its distance to a profile is the sum, over its own listed sequences, of how far apart the two ranks are, or the
profile size where the profile lacks one.  The nearest language is taken, the lesser code on a tie, and
none if no profile has any sequence of the text.  All numbers are whole.  Of a text to identify only
the first 1000 characters are looked at, by definition; profiles are trained on whole texts.

Identification is row-local: profiles are a model of a few hundred sequences per language, which travels with the
tasks, and only the letters of the looked-at part go to Python, in Arrow batches.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkmill.functions import text as T

PROFILE_SIZE = 300
MAX_MODEL_ROWS = 100_000
UNKNOWN = "unknown"
#: Distinct sequences a task counts before it passes them on.
COUNTED = 500_000
#: Characters that are numbered at a time, and rows whose texts are taken out of a batch at a time.
TOGETHER, ROWS = 250_000, 500

# Short plain texts in the languages known without any labelled data.
SAMPLES = {
    "da": "jeg vil gerne vide hvordan man kan lave en god side, og hvad der skal til for at det "
    "virker. kan du hjælpe mig med at skrive en kort tekst på dansk? det er ikke så svært, men "
    "jeg har brug for flere eksempler. hvor mange dage tager det, og hvem skal være med? vi har "
    "også nogle spørgsmål om arbejdet, som vi ikke selv kan svare på. tak for hjælpen, det var "
    "rigtig godt, og nu kan jeg komme videre med opgaven efter frokost sammen med de andre",
    "de": "ich möchte gerne wissen, wie man eine gute seite macht und was man dafür braucht. "
    "kannst du mir bitte helfen, einen kurzen text auf deutsch zu schreiben? es ist nicht so "
    "schwer, aber ich brauche noch einige beispiele. wie viele tage dauert das, und wer muss "
    "dabei sein? wir haben auch fragen zu der arbeit, die wir nicht selbst beantworten können. "
    "vielen dank für die hilfe, das war sehr gut, und jetzt kann ich mit der aufgabe weitermachen",
    "en": "i would like to know how to make a good page and what is needed for it to work. can "
    "you please help me write a short text in english? it is not that hard, but i still need "
    "some more examples. how many days will this take, and who should be there with us? we also "
    "have questions about the work which we could not answer on our own. thank you for the help, "
    "that was very good, and now i can go on with the rest of the task after lunch",
    "es": "me gustaría saber cómo se hace una buena página y qué hace falta para que funcione. "
    "¿puedes ayudarme a escribir un texto corto en español? no es tan difícil, pero todavía "
    "necesito algunos ejemplos más. ¿cuántos días lleva esto y quién tiene que estar? también "
    "tenemos preguntas sobre el trabajo que no podemos contestar nosotros mismos. muchas gracias "
    "por la ayuda, ha sido muy buena, y ahora puedo seguir con la tarea después de comer",
    "fr": "je voudrais savoir comment on fait une bonne page et ce qu'il faut pour que cela "
    "marche. peux-tu m'aider à écrire un texte court en français ? ce n'est pas si difficile, "
    "mais j'ai encore besoin de quelques exemples. combien de jours est-ce que cela prend, et "
    "qui doit être là ? nous avons aussi des questions sur le travail auxquelles nous ne pouvons "
    "pas répondre. merci beaucoup pour l'aide, c'était très bien, et je peux continuer la tâche",
    "it": "vorrei sapere come si fa una buona pagina e che cosa serve perché funzioni. puoi "
    "aiutarmi a scrivere un testo breve in italiano? non è così difficile, ma ho ancora bisogno "
    "di qualche esempio. quanti giorni ci vogliono e chi deve esserci? abbiamo anche delle "
    "domande sul lavoro alle quali non possiamo rispondere da soli. grazie mille per l'aiuto, è "
    "stato molto utile, e adesso posso andare avanti con il resto del compito dopo pranzo",
    "nl": "ik wil graag weten hoe je een goede pagina maakt en wat daarvoor nodig is. kun je mij "
    "helpen om een korte tekst in het nederlands te schrijven? het is niet zo moeilijk, maar ik "
    "heb nog enkele voorbeelden nodig. hoeveel dagen duurt dit, en wie moet erbij zijn? wij "
    "hebben ook vragen over het werk die wij niet zelf kunnen beantwoorden. hartelijk dank voor "
    "de hulp, dat was erg goed, en nu kan ik verder gaan met de rest van de opdracht",
    "pt": "eu gostaria de saber como se faz uma boa página e o que é preciso para que funcione. "
    "você pode me ajudar a escrever um texto curto em português? não é tão difícil, mas ainda "
    "preciso de alguns exemplos. quantos dias isso leva e quem tem de estar lá? também temos "
    "perguntas sobre o trabalho que não conseguimos responder sozinhos. muito obrigado pela "
    "ajuda, foi muito boa, e agora posso continuar com o resto da tarefa depois do almoço",
    "sv": "jag skulle vilja veta hur man gör en bra sida och vad som behövs för att den ska "
    "fungera. kan du hjälpa mig att skriva en kort text på svenska? det är inte så svårt, men "
    "jag behöver fortfarande några fler exempel. hur många dagar tar det, och vem måste vara "
    "med? vi har också frågor om arbetet som vi inte själva kan svara på. tack så mycket för "
    "hjälpen, det var väldigt bra, och nu kan jag fortsätta med resten av uppgiften",
}


def letters(text: Column | str) -> Column:
    """The words of a text, lower-cased, each with a blank on both sides."""
    given = F.col(text) if isinstance(text, str) else text
    words = F.regexp_replace(F.lower(given), r"[^\p{L}]+", " ")
    return F.concat(F.lit(" "), F.btrim(words), F.lit(" "))


def _counting(held: int, together: int = TOGETHER, rows: int = ROWS):
    """The task that counts the sequences of ``language, letters`` batches.

    What it holds beside a batch is bounded by ``held`` and ``together``, however many rows a batch has.
    """

    def counted(letters: str, own: int) -> tuple[np.ndarray, np.ndarray]:
        """The sequences that begin at the first ``own`` characters."""
        # A sequence is one number, 21 bits a character; those of different lengths never meet.
        c = np.frombuffer(letters.encode("utf-32-le"), np.uint32).astype(np.int64)
        blank = c == 32
        pairs = ((c[:-1] << 21) | c[1:])[:own]
        triples = ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[:own]
        found = [c[:own][~blank[:own]], pairs[~(blank[:-1] & blank[1:])[:own]], triples[~blank[1:-1][:own]]]
        return np.unique(np.concatenate(found), return_counts=True)

    def spelled(key: int) -> str:
        out = ""
        while key:
            key, last = key >> 21, key & 0x1FFFFF
            out = chr(last) + out
        return out

    def task(batches):
        import pyarrow as pa

        def passed_on():
            rows = [(language, spelled(key), n) for language, counter in counters.items() for key, n in counter.items()]
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = (pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["language", "gram", "n"])

        counters: dict[str, Counter] = {}
        for batch in (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows)):
            texts: dict[str, list[str]] = {}
            for language, letters in zip(batch.column("language").to_pylist(), batch.column("letters").to_pylist(), strict=True):
                texts.setdefault(language, []).append(letters or "")
            for language, some in texts.items():
                joined = "".join(some)
                for at in range(0, len(joined), together):
                    keys, n = counted(joined[at : at + together + 2], together)
                    counters.setdefault(language, Counter()).update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
                    if sum(map(len, counters.values())) > held:
                        yield passed_on()
                        counters = {}
        yield passed_on()

    return task


def profile(
    labelled: DataFrame, language: str = "lang", text: str = "text", size: int = PROFILE_SIZE
) -> DataFrame:
    """``language, rank, gram``: the most frequent sequences of every language.

    Tasks count before the shuffle, so what moves grows with the letters in use, not with the texts.
    """
    rows = labelled.filter(F.col(language).isNotNull()).select(F.col(language).alias("language"), letters(text).alias("letters"))
    counts = (
        rows.mapInArrow(_counting(COUNTED), "language string, gram string, n long")
        .groupBy("language", "gram")
        .agg(F.sum("n").alias("n"))
    )
    by_count = Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("rank", F.row_number().over(by_count))
        .filter(F.col("rank") <= size)
        .select("language", F.col("rank").cast("bigint").alias("rank"), "gram")
    )


def model(profile_rows: DataFrame, most: int = MAX_MODEL_ROWS) -> dict[str, list[str]]:
    """Profiles as a plain value, checked to have at most ``most`` sequences."""
    rows = profile_rows.select("language", "rank", "gram").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"language profiles have at most {most} n-grams")
    profiles: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["language"], r["rank"])):
        profiles.setdefault(r["language"], []).append(r["gram"])
    return profiles


def sample_model(spark: SparkSession) -> dict[str, list[str]]:
    """Profiles of the built-in samples."""
    rows = spark.createDataFrame(list(SAMPLES.items()), "lang string, text string")
    return model(profile(rows))


def identify(text: Column | str, profiles: dict[str, list[str]], size: int = PROFILE_SIZE) -> Column:
    """Language of a text whose profile is nearest, ``unknown`` without any letters the profiles know."""
    languages = sorted(profiles)
    rows = {gram: n for n, gram in enumerate(dict.fromkeys(g for grams in profiles.values() for g in grams))}
    places = np.full((len(rows) + 1, len(languages)), -1)
    for k, language in enumerate(languages):
        for rank, gram in enumerate(profiles[language]):
            places[rows[gram], k] = rank
    unknown = UNKNOWN

    # A sequence is one number, 21 bits a character from the left, so numbers are in the order of the sequences.
    spelled = {g: sum(ord(c) << 42 - 21 * k for k, c in enumerate(g)) for g in rows if 0 < len(g) <= 3 and "\0" not in g}
    known = np.array(sorted(spelled.values()), np.int64)
    row_of = np.array([rows[g] for g in sorted(spelled, key=spelled.__getitem__)] + [len(rows)], np.int64)
    known = np.append(known, -1)  # no sequence: stands behind all

    def ranked(letters: str) -> np.ndarray:
        """The sequences of a text, most frequent first, the lesser first among equals."""
        c = np.frombuffer(letters.encode("utf-32-le"), np.uint32).astype(np.int64)
        seen, first = c != 32, c << 42
        pairs = first[:-1] | c[1:] << 21
        keys, counts = np.unique(np.concatenate([first[seen], pairs, (pairs[:-1] | c[2:])[seen[1:-1]]]), return_counts=True)
        return keys[np.argsort(-counts, kind="stable")[:size]]

    def nearest(letters: pd.Series) -> pd.Series:
        out = []
        for given in letters:
            own = ranked(given) if given and given.strip() else np.empty(0, np.int64)
            place = np.searchsorted(known[:-1], own)
            at = places[np.where(known[place] == own, row_of[place], len(rows))]
            if not (at >= 0).any():
                out.append(unknown)
                continue
            apart = np.where(at >= 0, np.abs(at - np.arange(len(own))[:, None]), size)
            out.append(languages[int(apart.sum(axis=0).argmin())])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(nearest, "string")(letters(T.detection_prefix(text)))
