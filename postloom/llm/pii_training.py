"""Fitting the weights of ``pii``: python -m postloom.llm.pii_training. Sentences are made from frames with marked
slots, names and firms of made-up words or of usual ones; the conditional likelihood of their segmentations is climbed by
stochastic gradient with an L2 penalty. No sentence and no name is taken from any data."""

from __future__ import annotations

import json
import random

from postloom.llm import pii

SENTENCES, ROUNDS, RATE, PENALTY = 8000, 6, 0.15, 1e-3

FRAMES = """My own address is {EMAIL}, mail works best.|Mail {EMAIL} and copy {EMAIL}.|{EMAIL} bounced twice.|Forward it to {EMAIL}.|Invoices go to {EMAIL};{PHONE}.|mailto:{EMAIL}|From: {NAME} <{EMAIL}>
My number is {PHONE}, evenings are fine.|Ring {PHONE} and ask for {NAME}.|Fax: {PHONE}|Tel. {PHONE}|The hotline ({PHONE}) is dead.|phone={PHONE}|Meine Nummer ist {PHONE}.|Llame al {PHONE} por la tarde.|Mon numéro est le {PHONE}.|Ruf mich unter {PHONE} an.
Reach {NAME} on {PHONE} or {EMAIL}.|Best regards, {NAME}|Kind regards,\\n{NAME}|Cheers, {NAME}.|Yours sincerely, {NAME}|Signed, {NAME}|Viele Grüße, {NAME}|Freundliche Grüße\\n{NAME}|Un saludo, {NAME}.|Saludos, {NAME}. Gracias.|Bien cordialement, {NAME}.|Cordialement,\\n{NAME}
Please contact {NAME} at {EMAIL}.|Contact: {NAME}, {PHONE}|Contact: {NAME}, {EMAIL}|Customer: {NAME}; {EMAIL}; {PHONE}|Record: {NAME};{EMAIL};{PHONE};{ID_NUMBER}|Name: {NAME}, ID {ID_NUMBER}|user={NAME} id={ID_NUMBER}|owner: {NAME}
Dr. {NAME} said so.|Mrs. {NAME} called twice.|Mr. {NAME} of {FIRM} refused it.|Frau {NAME} war nicht da.|Herr {NAME} vom Einkauf hat zugesagt.|La señora {NAME} no contesta.|El Sr. {NAME} no contesta.|Mme {NAME} a répondu.|According to {NAME} the fix is out.|According to Prof. {NAME} the fix is out.
I met {NAME} at the fair.|I talked to {NAME} of {FIRM} on Monday.|We spoke to {NAME} about it.|I spoke with {NAME} and got no answer.|I talked to {NAME} yesterday.|{NAME} of {FIRM} never wrote back.|{NAME} of {FIRM} fixed it in a day.|{NAME} of {FIRM} promised a call.|{NAME} from {FIRM} said no.|DR. {NAME} AGREES.|Dr. {NAME} agrees with me.|{NAME} wrote to us again.|{NAME} signed the order.|The order was signed by {NAME}.|The plan comes from {NAME}, not from {FIRM}.
Is it true that {NAME} left {FIRM}?|Who runs {FIRM}, is it {NAME}?|Who at {FIRM} is {NAME}?|The new head of {FIRM} is {NAME}.|My boss {NAME} wants numbers.|Our manager, {NAME}, wants numbers.|A colleague, {NAME}, saw it too.|Meine Kollegin {NAME} hat es gesehen.|Mein Kollege {NAME} ({PHONE}) weiß mehr.|Mi compañero {NAME} lo vio.|The lock manager fails, our account manager left.|A colleague raised limits, un collègue l'a vu.|Ein Kollege hat es gesehen.|Mon collègue {NAME} l'a vu.
The contract person, {NAME} of {FIRM}, is ill.|My name is {NAME} and this is my first post.|Ich heiße {NAME}.|Me llamo {NAME}.|Je m'appelle {NAME}.|Bitte fragen Sie nach {NAME}.|Wenden Sie sich an {NAME}.|Pregunte por {NAME}.|Demandez {NAME} à l'accueil.|A question for {NAME} about seats|The card was made out to {NAME}, {ADDRESS}.|An account for {NAME} (tel. {PHONE}) was left open.|The account of {NAME} was left open.
I was born here, my social security number is {ID_NUMBER}.|Passport {ID_NUMBER} was in the dump.|The row held SSN {ID_NUMBER}.|The national identity number {ID_NUMBER} was shown.|They asked for my passport number {ID_NUMBER}.|identity number {ID_NUMBER} in {FILE}|Ausweis {ID_NUMBER} stand im Log.|Das Log zeigt die Ausweisnummer {ID_NUMBER}.|Mi DNI es {ID_NUMBER}.|Mon numéro d'identité est {ID_NUMBER}.|national_id={ID_NUMBER} ok|It leaked {ID_NUMBER} in {FILE}.|It printed "{ID_NUMBER}", which is mine.
Ship it to {ADDRESS}.|We moved to {ADDRESS} in May.|I live at {ADDRESS}.|Home address: {ADDRESS}|The parcel went to {ADDRESS} again.|The bill was sent to {NAME}, {ADDRESS}.|Die Rechnung an {ADDRESS} kam zurück.|Envíen la factura a {ADDRESS}.|Envoyez la facture au {ADDRESS}.|My street, {ADDRESS}, is unknown to the form.
{COMPANY} of {PLACE} never wrote back.|{FIRM} wrote to us again.|{FIRM} from {PLACE} said no.|I met {COMPANY} at the fair.|Ask for {COMPANY} support.|We talked to {COMPANY} on Monday.|Thanks, {FIRM} team|Kind regards, the {FIRM} team|Contact: {COMPANY}, {COMPANY}.|According to {FIRM} the fix is out.|A question for {COMPANY} about seats|The best answer is {FIRM}.|The card was made out to {COMPANY}.|{NOUN} von {FIRM} ist langsam.|Der {NOUN} von {FIRM} nach {FIRM} war lang.|Seit {NOUN} von {FIRM} weg.|Das {NOUN} von {FIRM} wegen der {NOUN} geprüft.|Neue {NOUN}, {NOUN} usw.|Mehr {NOUN}, {WORD} usw.|Ohne {WORD}, {WORD} und {NOUN} geht es.|{WORD}, {WORD} und {WORD} fehlen.|{NOUN} und {NOUN}, {NOUN} fehlen.|El {NOUN} de {FIRM} es lento.|La {NOUN} de {FIRM} no va.|Le {NOUN} de {FIRM} est lent.|El Sr. del {NOUN} de {COMPANY} dice que no.|Die Frau vom {NOUN} sagt nein.|The person from {COMPANY} said no.|M. le {NOUN} a répondu.|{NOUN} {VERB} {FIRM} {DATE}|{NOUN} of {FIRM} up again|{FIRM} wrote on {DATE} that it comes.|{FIRM} promised it for May.|{NOUN} {FIRM} is slow|{NOUN} vs {FIRM} for a wide table|{FIRM} Inc. will buy {FIRM}.|{FIRM} costs less than {FIRM}, by far.|We left {FIRM} for {FIRM}.|Is {FIRM} or {FIRM} better?|Wir nutzen {FIRM} seit Mai.|Con {FIRM} va bien.|Avec {FIRM} ça marche.|Does {FIRM} sell {FIRM} seats?|{PLACE} is a region, {PLACE} a zone.|The zone {PLACE} is down.|The {FIRM} plugin by {FIRM} is old.|{FIRM} AND {FIRM} ARE DOWN AGAIN, FIX IT.|WE PAID {FIRM} TWICE. NOBODY AT {FIRM} ANSWERS.
Mr. {GIVEN} asked.|{GIVEN} wrote it.|Thanks, {FAMILY}.|I asked {GIVEN} about it.|Ask for a refund, ask for more seats.|Contact: see below. Regards, the admin team|According to the docs it works.|They asked for help with the login.|Kind regards and thanks again for all|I spoke to the vendor twice, talked to an agent, met the limit.|a question for you all|Name: retry queue, owner: nobody|user=admin status=ok|The account for the trial was closed.
Order {CODE} is open.|Ticket {CODE} was closed.|Licence {CODE} ran out.|Trace id {CODE} is all we have.|Serial {CODE} on the box.|The error code {CODE} came back.|Checksum {CODE} is wrong.|Build {CODE} is bad.|Commit {CODE} broke it.|Ping gave {CODE}.|We wrote {CODE} rows.|Port {CODE} is shut.|Version {VERSION} of {VERSION} runs on {VERSION}.|driver@{VERSION} is fine.|git@host runs build@{VERSION}.|Ask @{HANDLE} or u/{HANDLE}.|See https://example.org/a?id={CODE} please.|On {DATE} it broke, on {DATE} again.|It took {NUMBER} days and {NUMBER} tries.|{NUMBER} Drive letters, {NUMBER} Street View tiles and {NUMBER} Way joins.|It was {NUMBER} hours on the road map.|It cost {NUMBER} dollars a seat at {NUMBER} Place settings.|Room {NUMBER} has {NUMBER} Court dates.""".replace("\n", "|").replace("\\n", "\n").split("|")

CITIES = "Springfield Riverton Altstadt Neuburg Villanueva Montfort Bridgewater Kingsport".split() + ["Green Valley", "Upper Marlow", "Saint Martin", "Port Louis"]
STEMS = ["Maple", "Church", "Station", "Mill Hill", "Old Forge", "Park", "Rose Garden", "North Pine", "Kings", "Orchard Bank"]
ENDS = "St. Street Ave Ave. Avenue Blvd. Boulevard Rd. Road Ln Lane Dr Drive Court Crescent Terrace Way".split()
PLAIN = "Silver North Bright Open River Stone Clear Swift Maple Iron Golden Deep Red Crystal Summit Bay Forest Cedar Amber Cloud Harbor Field Bridge Valley Point Tower Mill Peak Lake Garden".split()
NOUNS = "Wechsel Dienst Zugriff Server Sicherung Vertrag Tarif Rabatt Preis Anfrage Tabelle Abfrage Montag Weg Umzug Cache Speicher Precio Servicio Nube Panel Prix Service Panne Price Crash Backup Login Query Export Index".split()
TRADES = "Labs Systems Software Group Studio Tools Hosting Works Analytics Data Cloud Loader Cache Server Store Shard Loop Migrate SQL DB Storage Networks Partners".split()


def _digits(rng: random.Random, form: str) -> str:
    return "".join(str(rng.randrange(10)) if c == "9" else rng.choice("ABCD") if c == "A" else c for c in form)


def _made_up(rng: random.Random, syllables: int) -> str:
    return "".join(rng.choice("b d f g h j k l m n p r s t v w z br st th gr".split()) + rng.choice("a e i o u é ö ei ou".split()) + rng.choice(["", "", "n", "r", "l", "s"]) for _ in range(syllables)).title()


def _name_words(rng: random.Random) -> tuple[str, str]:
    given, family = rng.choice(pii.GIVEN).title(), rng.choice(pii.FAMILY).title()
    if rng.random() < 0.7:  # most names are in no list
        given = _made_up(rng, 2)
    if rng.random() < 0.7:
        family = _made_up(rng, 3)
        if rng.random() < 0.08:
            family = rng.choice([f"O'{family}", f"{family}-{_made_up(rng, 1)}"])
    return given, family


def _value(kind: str, rng: random.Random) -> str:
    pick = rng.choice
    if kind == "NAME":
        given, family = _name_words(rng)
        family = pick(["", "", "", "", "", "van der ", "Le ", "de "]) + family
        forms = [f"{given} {family}"] * 8 + [f"{family}, {given}", f"{given[0]}. {family}", f"{given} {pick('ABCG')}. {family}", f"{given} {_name_words(rng)[0]} {family}", f"{given} {family}".upper(), f"{given} {family}".lower(), f"{family.split()[-1]} {given}"]
        return pick(forms)
    if kind == "GIVEN":
        return _name_words(rng)[0]
    if kind == "FAMILY":
        return _name_words(rng)[1]
    if kind == "FIRM":
        word = pick([pick(PLAIN), pick(PLAIN), _made_up(rng, 2)])
        forms = [f"{word} {pick(PLAIN)}"] * 2 + [f"{word} {pick(TRADES)}"] * 4 + [f"{word} & {pick(PLAIN)} {pick(TRADES)}", f"{word} {pick(PLAIN)} {pick(TRADES)}", word + pick(["db", "base", "store", "cache", "stack"]), word]
        return pick(forms)
    if kind == "COMPANY":
        return f"{pick([pick(PLAIN), _made_up(rng, 2)])} {pick(TRADES)}"
    if kind == "WORD":
        return _made_up(rng, pick([2, 3, 4]))
    if kind == "NOUN":
        return pick(NOUNS)
    if kind == "VERB":
        return pick(["Breaks", "Drops", "Loses", "vs"])
    if kind == "PLACE":
        return pick(CITIES)
    if kind == "FILE":
        return pick(["a.sql", "app.log", "users.csv"])
    if kind == "HANDLE":
        return _made_up(rng, 2).lower() + pick(["", "_", "-"]) + str(rng.randrange(1000))
    if kind == "VERSION":
        return pick(["", "v"]) + ".".join(str(rng.randrange(30)) for _ in range(pick([2, 3])))
    if kind == "DATE":
        return _digits(rng, pick(["2026-19-19", "19.19.2026", "2026-19-19 19:59"]))
    if kind == "NUMBER":
        return str(rng.randrange(2, 900))
    if kind == "CODE":
        return pick([_digits(rng, pick(["999-99-999", "999-999-999", "999.999.999.999", "9999999999", "99999999999", "9999999999-999", "AAA-99999-9999", "AAA-99999", "9999999", "99999", "999999999999"])), f"{rng.getrandbits(40):010x}", pick("abcdef") + _digits(rng, "99999999") + pick("abcdef")])
    if kind == "EMAIL":
        a, b = (x.lower().replace("é", "e").replace("ö", "o").replace("'", "") for x in _name_words(rng))
        local = pick(["{a}.{b}", "{a}-{b}", "{a}{n}", "{a}_{b}{n}", "{b}.{a}+x", "{a}"]).format(a=a, b=b, n=rng.randrange(99))
        domain = pick(["example.org", "mail.example.com", "a-b.test", "uni.example", "a1b2.invalid"])
        form = pick(["@"] * 5 + ["(at)", " [at] ", "＠", " at "])
        if form in (" [at] ", " at "):
            domain = domain.replace(".", " [dot] " if "[" in form else " dot ")
        text = local + form + domain
        return text.title() if rng.random() < 0.1 and "@" in text else text
    if kind == "PHONE":
        return _digits(rng, pick(["+19999999999", "(415) 555-9999", "1-808-555-9999 ext. 99", "212.555.9999", "01 99 99 99 99", "+33 6 99 99 99 99", "07700 900999", "020 7946 9999", "+44 20 7946 9999", "0049 (0)30 / 23125-999", "+49 30 99999 999", "+1 (808) 555-9999", "617-555-9999", "+34 699 99 99 99"]))
    if kind == "ID_NUMBER":
        return _digits(rng, pick(["QQ 99 99 99 A", "QQ999999A", "999-99-9999", "999 99 9999", "X00999999", "1 99 99 99 999 999 99", "2 99 99 99 999 999 99", "99999999A"]))
    street, city = pick(STEMS), pick(CITIES)
    n = rng.randrange(1, 1900)
    us = f"{n} {street} {pick(ENDS)}"
    forms = [us, us.lower(), f"{us}, {city}", f"Flat {rng.randrange(1, 30)}, {us}, {city}", f"{us}, Apt {rng.randrange(1, 20)}C, {city} {_digits(rng, '99999')}", f"{n % 99 + 1} {pick(['bis ', ''])}{pick(['place du Marché', 'chemin des Prés', 'rue de la Gare'])}, {_digits(rng, '99999')} {city}"]
    forms += [f"{pick(['Calle Mayor', 'Paseo del Prado', 'C/ Nueva', 'Camino Viejo'])} {n % 99 + 1}, {n % 9 + 1}º {pick('ABCD')}", f"{pick(['P.O. ', ''])}Box {n}, {city}", f"{pick(['Lindenallee', 'Birkenweg', 'Hauptstraße', 'Schmale Gasse', 'Am Bahnhof', 'Bergstr.'])} {n % 99 + 1}, {_digits(rng, '99999')} {city}"]
    return pick(forms)


def sentence(rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """A text and its true segments."""
    text, gold = "", []
    for frame in rng.sample(FRAMES, 2):
        loud = rng.random() < 0.1  # some texts are in capitals
        while "{" in frame:
            head, rest = frame.split("{", 1)
            kind, frame = rest.split("}", 1)
            text += head.upper() if loud else head
            value = _value(kind, rng)
            if value.islower() and kind == "NAME" and not any(m.end() == len(text) for m in pii._CUED.finditer(text + "x")):
                value = value.title()  # in small letters only where something says that a name follows
            if loud and kind not in pii.KINDS:
                value = value.upper()
            if kind in pii.KINDS:
                gold.append((len(text), len(text) + len(value), kind))
            text += value
        text += (frame.upper() if loud else frame) + " "
    return text, gold


def train(n: int = SENTENCES, rounds: int = ROUNDS, seed: int = 11) -> dict[str, float]:
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        text, gold = sentence(rng)
        cands = pii.candidates(text)
        true = {(a, k): b for a, b, k in gold}
        right, taken = [], set()
        for i, (a, b, k, _) in sorted(enumerate(cands), key=lambda x: abs(x[1][1] - true.get((x[1][0], x[1][2]), 10**6))):
            if (a, k) in true and (a, k) not in taken and abs(b - true[a, k]) <= (0 if k == "NAME" else 12):
                taken.add((a, k))
                right.append(i)
        right.sort(key=lambda i: cands[i][0])
        pairs = [pii.neighbours(cands[i][:3], cands[j][:3]) for i, j in zip(right, right[1:])]
        data.append((cands, set(right), [f for f in pairs if f]))
    w: dict[str, float] = {}
    for r in range(rounds):
        rng.shuffle(data)
        step = RATE / (1 + r)
        for cands, right, pairs in data:
            spans = [(a, b, sum(w.get(f, 0.0) for f in fs)) for a, b, _, fs in cands]
            _, p, expected = pii.expectations(spans, [c[2] for c in cands], w)
            for i, (_, _, _, fs) in enumerate(cands):
                g = (i in right) - p[i]
                if abs(g) > 1e-4:
                    for f in fs:
                        w[f] = w.get(f, 0.0) * (1 - step * PENALTY) + step * g
            for f in pairs:
                expected[f] = expected.get(f, 0.0) - 1
            for f, g in expected.items():
                w[f] = max(-pii.REACH, min(pii.REACH, w.get(f, 0.0) * (1 - step * PENALTY) - step * g))
    return {k: round(v, 4) for k, v in sorted(w.items()) if abs(v) >= 5e-4}


if __name__ == "__main__":
    pii.WEIGHTS.write_text(json.dumps(train(), indent=0, ensure_ascii=False, sort_keys=True) + "\n")
