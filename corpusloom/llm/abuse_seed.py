"""Labelled text the abuse classifier is trained on: sentence patterns, the words that fill them, and ways to disguise them.

The lists are fixed values written for this purpose; training sentences are drawn from them by rule. They hold abusive
language because a classifier has to see what it is to find.
"""

from __future__ import annotations

import random

#: Insults for one person, and names of animals and things that insult only when said of people.
INSULT = "idiot moron asshole bastard scumbag wanker cretin imbecile dumbass pig rat parasite whore bitch cunt slut leech dickhead prick twat retard bellend fuckwit tosser loser swine cockroach dipshit shithead motherfucker|piece of shit|waste of space|son of a bitch"
BESCHIMPFUNG = "Idiot Arschloch Hurensohn Wichser Drecksack Abschaum Schlampe Schwachkopf Vollpfosten Penner Bastard Fotze Missgeburt Drecksau Vollidiot Hure Nutte Trottel Spast Parasit Schwein Ratte Pissnelke Mistkerl Dreckschwein Scheißkerl Kanake Depp Lump Flittchen Blödmann Sackgesicht Saftsack"
#: Words that lower a person or group.
VILE = "stupid filthy disgusting pathetic worthless spineless braindead stinking miserable lying rotten ugly dirty brainless vile sick useless revolting"
ELEND = "dumme dreckige widerliche erbärmliche wertlose feige hirnlose stinkende elende verlogene verkommene hässliche dämliche ekelhafte"
#: Groups of people. Names of peoples that do not exist stand for those that do.
GROUP = "those Ostrelians|Velmarians|hill folk|river people|the camp people|the Tarvik lot|these newcomers|these foreigners|the lantern faithful|journalists|immigrants|refugees|these migrants|women|the northerners|those believers|the gays|these people|politicians|the Hexley lot|Kelbridgers|Muslims|Jews|gypsies|these asylum seekers"
GRUPPE = "die Ostreller|diese Velmarker|die aus dem Lager|die Flussleute|diese Zugereisten|diese Laternenweiber|die Ausländer|diese Flüchtlinge|die Journalisten|die Hügelleute|diese Gläubigen|die Frauen|diese Asylanten|die Muslime|die Juden|diese Fremden|die Tarvikler|solche Leute|die Politiker|die Schwulen"
#: What groups are called to deny that they are people.
FILTH = "garbage|a disease|subhuman filth|vermin|human waste|a plague|parasites|animals|cockroaches|rats|a cancer|trash|scum|leeches|an infestation"
UNRAT = "Vieh|Untermenschen|Ungeziefer|eine Seuche|Abschaum|Parasiten|Müll|eine Krankheit|Ratten|Zecken|Dreck|Tiere|Schmarotzer|ein Krebsgeschwür"
ROLE = "the mayor|the hospital director|the press officer|the auditor|the harbour master|the school inspector|the housing senator|the union chair|the finance officer|the council leader|the police spokesperson|the transport minister|the teacher|my neighbour|the editor"
AMT = "der Bürgermeister|die Schulrätin|der Klinikleiter|die Bausenatorin|der Hafenmeister|die Kämmerin|der Gewerkschaftschef|die Verkehrsministerin|der Ratsvorsitzende|die Polizeisprecherin|der Oberbürgermeister|die Lehrerin|der Redakteur"
PLACE = "Hexley|Dornholm|Sollingen|Velmark|Ullmere|Kelbridge|Grauwick|Marrowgate|Eastmoor|Quillbury|town|this city|Brackwater"
ORT = "Hexlau|Dornholm|Sollingen|Velmark|Ullmeer|Kelbrück|Grauwiek|Ostmoor|Quellburg|Brackwasser|der Stadt"
THING = "speed limit|school budget|harbour tunnel|night bus|water charge|housing cap|ferry subsidy|bus timetable|pension reform|market hall|refugee shelter|parking tariff|wind farm permit|clinic|playground|bridge|library|tram stop"
DING = "Tempolimit|Schulhaushalt|Hafentunnel|Rundfunkbeitrag|Heizungsgesetz|Schulessen|Windpark|Fahrpreis|Mietendeckel|Radwegeplan|Busfahrplan|Rechenzentrum"

#: Abusive patterns. {i} insult, {is} insults, {v} vile, {g} group, {f} filth, {r} role, {p} place, {c} threat; German in capitals.
THREAT = "we will burn your house down|I know where you live and I am coming|go hang yourself|drop dead|someone should break your legs|you will get a bullet one day|I hope you choke|do the world a favour and jump|I hope you die|kill yourself|we will find you|watch your back tonight|you will bleed for this|your children will pay for this"
DROHUNG = "wir zünden dein Haus an|ich weiß, wo du wohnst, ich komme|häng dich auf|ich hoffe, du verreckst|dir sollte man die Beine brechen|spring doch von der Brücke|bring dich um|du kriegst noch eine Kugel|wir finden dich|verrecke endlich|ich mach dich fertig|ich schlag dir die Zähne aus"
LEWD = "suck my cock|show me your tits|I want to fuck you all night|my dick is hard for you|come here and lick my pussy|bend over and spread your legs|I am so horny, let me cum on your face|send nudes, you slut|I would love to bang you in the back of the car|sit on my face|let me grab your ass|take your clothes off for me|get naked and I will tell you what your opinion is worth"
GEIL = "lutsch meinen Schwanz|zeig deine Titten|ich will dich die ganze Nacht ficken|mach die Beine breit|ich bin so geil auf dich, ich spritze gleich ab|leck meine Muschi|setz dich auf mein Gesicht|schick mir Nacktbilder, du Schlampe|ich fick dich durch|zieh dich aus, dann sage ich dir, was deine Meinung wert ist|blas mir einen"
FATE = "they should be driven out|they have no right to live among us|they do not deserve to breathe our air|they should be drowned in the river|they ought to be shot at the border|somebody should put them all down|they belong in a cage|they should be locked up and forgotten|send them back to the sea|they should be wiped out|let them starve"
SCHICKSAL = "die gehören in den Käfig|die sollte man ersäufen|die haben kein Recht, unter uns zu leben|die gehören an die Wand gestellt|die sollte man alle abschieben und vergessen|die verdienen unsere Luft nicht|die gehören ausgerottet|man sollte sie davonjagen"

ABUSIVE = """You are a {v} {i}.
What a {v} {i} you are.
Only a {v} {i} would ask.
Only {v} {is} write things like that.
Everyone who talks like that is a {v} {i}.
Fuck off, you {v} {i}.
Shut your mouth, you {v} {i}.
Stfu you {v} {i}
Stfu you {v} 🐷
Go to hell, you {i}.
Piss off, {i}.
Get lost, you {v} {i}.
{r} is a {v} {i}.
{r} is nothing but a {i}.
Hang all {v} {is} like {r}.
{g} are {f}.
{g} are {f}
{g} are {f}!
All of {g} are {f}.
{g} are nothing but {f}.
{g} are nothing but {v} {is}, {x}.
{g} are {v} {is}, {c}.
{g} should be driven out.
Every one of {g} is a {v} {i}.
All of {g} are {is}.
I hate {g}, {x}.
Gtfo of {p}, {v} {is}
Get out of {p}, you {v} {is}.
Imagine being such a {v} {i} that even {p} does not want you.
You are a {i} and your kids are {is}
You are a 🐀 and {r} is a bigger 🐀, stinking through and through.
You are nothing but a 🐷
Your mother is a {i}.
{c}.
{c}, {i}.
{c}, you {v} {i}.
I swear {c}.
{l}.
{l}, {i}.
{l}, you {v} {i}.
{r} is so hot, {l}.
A rope and a tree, that is all {g} need.
The world gets cleaner every time one of {g} goes under the ice.
There is enough space in the {t} to lock {g} in and lose the key.
I would not trust {g} to be counted as people.
We should have let {g} freeze last winter.
Back on the boat with {g}, and drill a hole in it first.
{g} only understand the whip.
Your kind only understands the whip.
People like you should have been left at the side of the road at birth.
Did your mother drop you on your head, or were you born like this?
Nobody would miss you, think about that tonight.
Hope your brakes fail on the way home from {p}.
Your daughter will pay for what you wrote, we know her school in {p}.
Somebody ought to teach you a lesson you will not wake up from.
I have scraped smarter things off my shoe than {r}.
You smell through the screen.
With a face like yours I would keep a bag over my head.
Women like you are good for one room of the house only.
Nice legs on {r}, pity about the clothes, I would have a go in the back of the car.
Take your clothes off and I will tell you what your opinion is worth.
It would be a better world without you in it.
Too bad your parents did not have the sense to stop before you.
Someone should lock the doors and light a match with {g} inside.
{g} breed like rabbits and should be treated like them.
We do not need {g} here, the river is deep enough.
A bullet is cheaper than feeding {g}.
You deserve to be beaten until you cannot stand.
Watch your windows, stones fly far in {p}.
You are too dumb to breathe.
Typical {i}.
{g} have no right to live.
{g} must all go, by force if need be.
{g} will not stop until somebody stops them for good.
Kys {i}
You {v} {i}, and everybody knows it.
You {v} {i}
{g} belong in a cage.
{g} must be wiped out.
{g} should be drowned in the river.
Burn {g}, all of them.
Somebody should shoot {g}.
You have the brain of a dead fish.""".split("\n")

BELEIDIGEND = """Du {E} {I}.
Du {I}!
Was für ein {I} du bist.
Halt die Fresse, du {I}.
Halt dein Maul, du {E} {I}.
Verpiss dich, du {I}.
Verzieh dich, du {E} {I}.
Hdf du {I}
Typisch {I}.
Jeder, der so redet, ist ein {I}.
Nur ein {I} fragt so etwas.
{R} ist ein {I}.
{R} ist doch ein {E} {I}.
{G} sind {F}.
{G} sind {F}
{G} sind {F}!
{G} sind alle {F}.
{G} sind nichts als {F}, {X}.
{G} sind {F}, {X}.
{G} gehören in den Käfig.
{G} gehören aufgehängt.
Ich hasse {G}, {X}.
Raus mit {G}, alles {F}.
{C}.
{C}, du {E} {I}.
Du {I}, {C}.
Du 🐷, {C}.
Du 🐀, verpiss dich.
{L}.
{L}, du {I}.
{L}, du Sau.
Ein Strick und ein Baum, mehr brauchen {G} nicht.
Im letzten Winter hätte man {G} einfach erfrieren lassen sollen.
Zurück ins Boot mit denen, und vorher ein Loch hineinbohren.
Deinesgleichen versteht nur die Peitsche.
{G} verstehen nur die Peitsche.
Die Welt wird sauberer, jedes Mal wenn einer von denen untergeht.
In der Turnhalle ist genug Platz, um {G} einzusperren und den Schlüssel zu verlieren.
Ich würde {G} nicht zu den Menschen zählen.
Leute wie dich hätte man gleich nach der Geburt aussetzen sollen.
Hat dich deine Mutter zu oft fallen lassen?
Dich würde niemand vermissen, denk heute Nacht mal darüber nach.
Hoffentlich versagen dir auf dem Heimweg nach {P} die Bremsen.
Deine Tochter wird dafür bezahlen, wir kennen ihre Schule in {P}.
Dir muss mal jemand eine Lektion erteilen, von der du nicht mehr aufwachst.
Ich habe schon Klügeres von der Schuhsohle gekratzt.
Du stinkst durch den Bildschirm.
Mit so einem Gesicht würde ich mir eine Tüte über den Kopf ziehen.
Frauen wie du taugen nur für ein Zimmer im Haus.
Schöne Beine hat {R}, schade um die Kleider, ich würde sie mal rannehmen.
Die Welt wäre ohne dich besser dran.
Du bist zu blöd zum Atmen.
Du miese Kackbratze.
{G} haben kein Recht zu leben.
{G} müssen alle raus, notfalls mit Gewalt.
{G} gehören ausgerottet.
Man sollte {G} alle erschießen.
Eine Kugel ist billiger als {G} durchzufüttern.
Pass auf deine Fenster auf, Steine fliegen weit in {P}.""".split("\n")

#: Harmless patterns that use, report, quote or reject such words, or attack a decision with heat. {w} an insult, {th} a thing.
HARMLESS = """Somebody wrote '{w}' on the wall of the {th}, it was painted over on Monday.
Please stop using the word '{w}' here, it helps nobody.
Comments such as '{c}' were reported to the police in {p}.
She quoted the letter, '{l}', and asked why the platform did nothing.
He read out the message '{c}' in court.
{r} was called a {v} {w} in the street, the court has now fined the man.
{r} says being called a {w} online has become normal.
Calling {g} {f} is exactly the language we should not accept.
Nobody should call {g} {f}.
It is wrong to say that {g} are {f}.
The museum in {p} shows how propaganda called people {f} before the war.
The book describes how the regime called people {f}.
A man who shouted '{w}' at a nurse has to pay a fine.
I was the idiot who forgot the keys of the {th}, sorry everyone.
I am such an idiot, I missed the bus.
The pest controller found cockroaches and a rat in the cellar of the {th}.
The vermin on the allotments are a plague this May, says {r}.
Parasites on the lime trees: {r} had 900 trees felled.
Ticks in the park of {p}: {r} recommends long trousers.
The pigs of the farm near {p} won a prize.
The rats in the harbour are a nuisance, the council has hired a cat.
He shot the pig farm documentary in {p} in August.
That penalty was a killer, {p} won by 3.
The bastard sword and other plays open in {p} on Friday.
Breast cancer screening returns to {p} in June, 12 appointments are open.
Sex education will be taught from year six, {r} revived the plan.
Nude study by an unknown painter bought by the town hall for 900 euros.
The cock crows at five in {p} and 70 residents have complained.
Kill the {th} already, it is {v}.
The {th} makes me sick, 900 euros for nothing!!!
I hate the {th}, I really do.
Damn, that {th} is {v}.
What a {v} idea, the {th}.
The {th} is garbage and everybody knows it.
This is complete nonsense and you know it.
What a disgrace, {r} should resign today.
Shame on the opposition for the {th}.
{r} lied about the {th}, read the minutes.
Are you serious??? The coalition failed {p} AGAIN.
The opposition failed {p} again.
Fucking weather today.
f***ing weather
Oh shit, the rain
Oh sh*t, the rain
Wtf, the {th} is late.
B*tter late than never
H4ppy Friday
n o p e
w a i t ... what
🐷 market today?
The slaughterhouse in {p} closes, 40 jobs are gone.
The film shows a hanging, viewers are warned.
The fire in {p} burned a house down, nobody was hurt.
Jump from the bridge is forbidden, says {r}.
A dog bit the postman, his legs are fine.
The bullet train to {p} is late again.
The {th} is a disease of this budget, cut it.
Dick Turner and Randy Cox won the regatta.
Scunthorpe and Penistone get a new library.
Stop calling each other names and read the draft.
People are more than their worst comment.
We should welcome {g}, they have been patient.
{g} deserve an apology.
{g} asked for a new library.
{g} are our neighbours and they pay their taxes.
I disagree with {r}, but the hearing was fair.
Hate speech against {g} must be deleted.
The threats against {r} are being investigated.""".split("\n")

HARMLOS = """Jemand hat '{W}' an die Schule geschrieben, am Montag wurde es übermalt.
Bitte lasst das Wort '{W}' hier weg, es hilft niemandem.
Sätze wie '{C}' wurden in {P} angezeigt.
Sie las den Brief vor, '{L}', und fragte, warum niemand etwas tat.
{R} wurde als {W} beschimpft, das Gericht hat den Mann verurteilt.
Menschen {F} zu nennen ist genau die Sprache, die wir nicht dulden sollten.
Niemand sollte {G} {F} nennen.
Das Museum in {P} zeigt, wie die Propaganda Menschen {F} nannte.
Ich Idiot habe den Schlüssel der Bücherei vergessen, Entschuldigung.
Der Kammerjäger fand eine Ratte im Keller der Bücherei.
Zecken im Park von {P}: {R} rät zu langen Hosen.
Das Ungeziefer in den Gärten ist eine Plage, sagt {R}.
Parasiten an den Linden: {R} ließ 300 Bäume fällen.
Die Sau ist aus dem Gehege in {P} ausgebrochen, 12 Anwohner suchten mit.
Der Hahn kräht um fünf in {P}, 70 Anwohner haben sich beschwert.
Sexualkunde gibt es künftig ab Klasse sechs, sagt {R}.
Brustkrebsvorsorge ab Februar wieder in {P}, 24 Termine frei.
Der Akt eines unbekannten Malers hängt jetzt im Rathaus.
Ich hasse das {D}, wirklich.
Das {D} macht mich krank, 900 Euro für nichts!!!
Verdammt, das {D} ist dumm.
Verdammt, das {D} ist {E}.
Eine Schande, {R} sollte zurücktreten.
Schämt euch, {P} wartet seit Mai.
Das ist völliger Unsinn und das weißt du auch.
Wtf, das ist überstürzt.
Mist, das ist teuer.
Scheiß Wetter heute.
M#rgen zusammen
Tötet endlich das {D}, es ist wertlos.
Der Elfmeter war mörderisch, {P} gewann mit 3.
{R} hat beim {D} gelogen, lest das Protokoll.
Das Schweinefest in {P} beginnt am Freitag.
Das Haus in {P} ist abgebrannt, niemand wurde verletzt.
{G} haben eine Entschuldigung verdient.
{G} sind unsere Nachbarn.
Hass gegen {G} muss gelöscht werden.
Die Drohungen gegen {R} werden untersucht.
Ich bin anderer Meinung als {R}, aber die Anhörung war fair.""".split("\n")

#: Fillers of a conversation.
SHORT = "That is all.|See you at the meeting.|See you tomorrow.|See you there.|Ask the people affected.|Happy to be corrected.|Let us see.|Not holding my breath.|We will be reading the fine print.|We will see.|Good night.|Good morning.|Have a nice day.|I will be there.|We are coming.|Fragt die Betroffenen.|Ich lasse mich gern korrigieren.|Bis zur Sitzung.|Bis morgen.|Guten Morgen.|Wir kommen.|Time will tell.|Worth a read.|Source please?|Are you serious???|Make of that what you will.|#transport|#council|#rat|#vale|Mist,|Wtf,|Yes!|No!|Nein!|Ja.|So,|What|Das war es.|Abwarten.|Mal sehen.|Ich warte noch auf eine Antwort.|Quelle bitte?|Lesenswert.|90% agreed.|*sigh*|:)|Danke.|Thanks!"

#: Neutral sentences that stand beside abuse in a text.
PLAIN = """The {th} was reworked once again.
According to the minutes it was 900 buses, not 12.
{r} opened the {th} in {p} on Sunday.
I voted for the opposition and I still call the {th} late.
In {p} we have been waiting since May for the {th}.
Thank you for the summary of the {th}.
Read the survey again, page 12.
Still waiting for an answer.
My neighbour in {p} counted 70 tenants in one morning.
Does the {th} also cover {p}?
The figures from {p} are solid: 55 beds in June.
Two years ago the council promised a new {th} for {p}.
Around here people say the {th} was shelved in the end.
Ich finde, das {D} ist überfällig.
{R} hat das {D} verschoben, betroffen sind 900 Mieter in {P}.
Danke für die Übersicht zu {P}.
In {P} warten wir seit Mai auf die Schule.
Laut {P} waren es 70 Haushalte, nicht 12.
Im Protokoll steht das anders, Seite 7.
Hat in {P} jemand gelesen, was im Entwurf steht?
Gilt das auch für die Brücke in {P}?""".split("\n")


def _words(text: str) -> list[str]:
    first, *phrases = text.split("|")
    return [*first.split(), *phrases]


SINGLE = {"i": _words(INSULT), "v": VILE.split(), "E": ELEND.split(), "I": BESCHIMPFUNG.split()}
PHRASES = {"g": GROUP, "G": GRUPPE, "f": FILTH, "F": UNRAT, "r": ROLE, "R": AMT, "p": PLACE, "P": ORT, "c": THREAT, "C": DROHUNG, "l": LEWD, "L": GEIL, "x": FATE, "X": SCHICKSAL, "th": THING, "D": DING, "t": THING}
FILL = SINGLE | {k: v.split("|") for k, v in PHRASES.items()}
FILL |= {"w": FILL["i"], "W": FILL["I"], "is": [w + "s" if not w.startswith(("piece", "waste", "son", "bitch")) else {"b": "bitches"}.get(w[0], w.replace(" of", "s of", 1)) for w in FILL["i"]]}

#: Letters that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("асеорхуіѕјԁһɡмтвнкАСЕОРХУІЅЈМТВНКαορνικ", "aceopxyisjdhgmtbhkACEOPXYISJMTBHKaopvik"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "€": "e", "!": "i"}


def fill(pattern: str, rng: random.Random, disguise: float) -> str:
    """``pattern`` with its slots filled, each filled word disguised with the given chance."""
    out = pattern
    for slot, words in FILL.items():
        mark = "{" + slot + "}"
        while mark in out:
            word = rng.choice(words)
            if rng.random() < disguise and slot not in ("p", "P", "th", "t", "D", "r", "R"):
                word = hide(word, rng)
            out = out.replace(mark, word, 1)
    return out[:1].upper() + out[1:]


def hide(word: str, rng: random.Random) -> str:
    """``word`` as people spell it to get past a filter."""
    way = rng.randrange(7)
    at = [i for i, ch in enumerate(word) if ch.isalpha()]
    if len(at) < 3:
        return word
    inner = at[1:-1]
    vowels = [i for i in inner if word[i] in "aeiouäöü"] or inner
    if way == 0:
        i = rng.choice(vowels)
        return word[:i] + rng.choice("*#") + word[i + 1 :]
    if way == 1:
        i = rng.choice(inner)
        return word[:i] + "**" + word[i + 2 :]
    if way == 2:
        back = {v: k for k, v in SIGNS.items()}
        return "".join(back.get(c, c) if c in back and rng.random() < 0.7 else c for c in word)
    if way == 3 and " " not in word:
        return rng.choice([" ", ".", "-"]).join(word)
    if way == 4:
        back = {v: k for k, v in LOOKALIKES.items()}
        return "".join(back.get(c, c) if rng.random() < 0.7 else c for c in word)
    if way == 5:
        i = rng.choice(vowels)
        return word[:i] + word[i] * rng.randint(3, 8) + word[i + 1 :]
    i = rng.choice(inner)
    return word[:i] + "\u200b" + word[i:]


def labelled(n: int, seed: int) -> tuple[list[str], list[int]]:
    """``n`` labelled sentences, half of them abusive; the same for the same ``seed``."""
    rng = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        bad = k % 2
        pool = (ABUSIVE, BELEIDIGEND) if bad else rng.choice([(HARMLESS, HARMLOS), (HARMLESS, HARMLOS), (PLAIN, SHORT.split("|"))])
        text = fill(rng.choice(pool[rng.random() < 0.42]), rng, 0.45 if bad else 0.15)
        if rng.random() < 0.15:
            text = text.upper()
        elif rng.random() < 0.15:
            text = text.lower()
        if rng.random() < 0.3:
            beside = fill(rng.choice(PLAIN), rng, 0)
            text = f"{text.rstrip('.')} {rng.choice(['🤮', '🖕', '', '!!!', '...'])} {beside}" if rng.random() < 0.5 else f"{beside} {text}"
        texts.append(text)
        labels.append(bad)
    return texts, labels
