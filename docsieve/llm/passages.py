"""A labelled table of passages for problem 8, written for it: frames with slots, beside the reviewed samples of the data.

No passage is taken from the data. Frames cover what such language does (insults, threats, wishes of
harm, contempt for a group, explicit scenes) and what only looks like it (expletives aimed at nobody,
clinical, figurative and technical words, neutral reports).
"""

from __future__ import annotations

import random

SLOTS = {
    "I": [
        "idiot", "moron", "imbecile", "bastard", "bitch", "asshole", "scumbag", "dickhead", "prick", "cunt", "wanker", "piece of shit", "piece of garbage", "son of a bitch", "motherfucker", "jackass", "dumbass", "loser", "pig", "cow", "rat",
        "snake", "creep", "pervert", "coward", "liar", "crook", "parasite", "slut", "whore", "retard", "freak", "clown", "fool", "swine", "cockroach", "dipshit", "twat", "tosser", "douchebag", "shithead", "fuckwit", "halfwit", "weasel", "leech", "hag", "thug", "waste of space", "lowlife", "numbskull",
    ],
    "A": ["stupid", "fucking", "filthy", "lazy", "ugly", "worthless", "pathetic", "disgusting", "fat", "dumb", "brainless", "miserable", "rotten", "goddamn", "useless", "lying", "spineless", "nasty", "dirty", "old", "ignorant", "greedy", "vile", "sick", "bloody", "shitty", "hopeless", "crooked", "arrogant", "repulsive"],
    "W": ["nurse", "mechanic", "cop", "officer", "neighbour", "driver", "manager", "lawyer", "agent", "boss", "doctor", "judge", "inspector", "cashier", "landlord", "paramedic", "secretary", "trucker", "deputy", "biker", "insurance man", "woman at the desk", "guy in the van", "teacher"],
    "G": [
        "immigrants", "foreigners", "refugees", "migrants", "Muslims", "Jews", "Christians", "Hindus", "Blacks", "whites", "Asians", "Mexicans", "Arabs", "Africans", "gypsies", "gays", "lesbians", "trans people", "women", "men", "old people", "teenagers", "disabled people", "cripples", "the homeless", "the poor",
        "northerners", "southerners", "city folk", "farmers", "islanders", "mountain people", "river people", "Orlandi", "Tesharu", "Quomish", "people of that faith", "people like them", "those believers", "female drivers", "asylum seekers", "outsiders", "pensioners", "natives", "newcomers", "nomads", "border people",
    ],
    "B": ["teeth", "jaw", "neck", "skull", "legs", "fingers", "arms", "nose", "ribs", "face", "head", "kneecaps", "throat", "back", "hands", "eyes"],
    "K": ["kill", "murder", "strangle", "shoot", "stab", "beat", "hurt", "choke", "bury", "butcher", "cripple", "gut", "hang", "drown", "burn", "punch", "whip"],
    "F": ["wife", "kids", "mother", "children", "daughter", "family", "husband", "son", "dog", "sister"],
    "P": ["house", "home", "shop", "office", "car", "truck", "barn", "place", "workshop", "garage"],
    "D": ["cancer", "a stroke", "hunger", "the plague", "a heart attack", "pain"],
    "V": ["animals", "vermin", "rats", "parasites", "savages", "monkeys", "pigs", "filth", "scum", "trash", "a plague", "a disease", "a cancer", "criminals", "thieves", "cockroaches", "subhuman", "dirt", "garbage", "dogs", "lice", "inferior", "degenerates", "a curse", "rapists"],
    "T": ["tits", "breasts", "ass", "pussy", "dick", "cock", "nipples", "thighs", "clit", "balls", "crotch", "butt", "boobs", "cunt"],
    "X": ["fuck", "lick", "suck", "ride", "touch", "kiss", "stroke", "squeeze", "grope", "taste", "spank", "finger", "screw", "bang"],
    "Y": ["fucking", "licking", "sucking", "riding", "stroking", "fingering", "screwing", "groping", "spanking", "masturbating", "jerking off", "undressing", "moaning", "thrusting", "having sex"],
    "L": ["in the parking lot", "on the back seat", "in the cab", "behind the bar", "in the shower", "on the desk", "under the bridge", "in the tent", "at the rest stop", "in the truck", "on the couch", "by the road", "in the elevator", "on the hood", "in the bedroom"],
    "es_I": ["idiota", "imbécil", "cabrón", "puta", "hijo de puta", "pendejo", "gilipollas", "mierda", "basura", "cerdo", "perra", "zorra", "malnacido", "estúpido", "payaso", "asqueroso", "rata", "maricón", "bruja", "vaca", "inútil", "desgraciado", "cretino", "bestia", "guarra", "cobarde"],
    "es_G": ["extranjeros", "inmigrantes", "refugiados", "gitanos", "moros", "negros", "judíos", "maricones", "viejos", "norteños", "sureños", "pobres", "indios", "forasteros", "creyentes", "isleños", "migrantes", "musulmanes"],
    "es_W": ["policía", "vecino", "médico", "abogado", "jefe", "conductor", "camionero", "juez", "cajero", "perito", "dueño", "portero"],
    "es_V": ["animales", "ratas", "una plaga", "ladrones", "basura", "escoria", "parásitos", "cucarachas", "inferiores", "criminales", "bestias", "una peste", "perros", "violadores", "una enfermedad"],
    "es_T": ["tetas", "culo", "coño", "polla", "pechos", "verga", "pezones", "muslos", "nalgas"],
    "fr_I": ["idiot", "imbécile", "connard", "connasse", "salope", "pute", "fils de pute", "enculé", "ordure", "merde", "abruti", "crétin", "porc", "truie", "salaud", "con", "conne", "raclure", "pourriture", "vache", "bouffon", "lâche", "débile", "garce", "charogne"],
    "fr_G": ["étrangers", "immigrés", "réfugiés", "gitans", "arabes", "noirs", "juifs", "pédés", "vieux", "femmes", "migrants", "musulmans", "pauvres", "croyants", "sudistes", "voisins du nord", "handicapés", "roms"],
    "fr_W": ["flic", "voisin", "médecin", "avocat", "patron", "chauffeur", "juge", "caissier", "greffier", "gardien", "facteur"],
    "fr_V": ["animaux", "rats", "vermine", "voleurs", "déchets", "parasites", "cafards", "inférieurs", "criminels", "bêtes", "une peste", "des chiens", "une maladie", "ordures", "sauvages"],
    "fr_T": ["seins", "cul", "chatte", "bite", "nichons", "fesses", "cuisses", "queue", "tétons"],
}

ABUSE = [
    "You {A} {I}!", "You are such a {I}.", "you {I}, I hope you choke", "He screamed that I was a {A} {I}.", "Only a {A} {I} would drive like that.", "That {W} is a {A} {I}.", "The {W} is a complete {I}, everyone says so.", "Listen, {I}, nobody asked you.",
    "What a {A} {I} that {W} is.", "She called the {W} a {A} {I} to his face.", "Shut up, {I}.", "Shut the fuck up, you {A} {I}.", "Drop dead, {I}.", "Fuck off, {I}!", "Go to hell, you {A} {I}.", "Screw you and your {F}.", "My message to the {W}: you are a {I}.",
    "Kiss my ass, {I}.", "Your {F} should be ashamed of raising such a {I}.", "I will {K} you.", "I'll {K} you, {I}.", "I am going to {K} that {W}.", "I swear I'll {K} you and your {F}.", "Next time I will break your {B}.", "I'm going to smash your {B} in.", "Come near me again and I'll {K} you.", "He said he would {K} the {W} if she talked.",
    "Somebody should {K} that {W}.", "People like that {W} deserve to be {K}ed.", "I hope you die of {D}.", "I hope the {W} gets {D}.", "I hope your {F} dies {L}.", "May you rot in prison, {I}.", "I wish you had been killed that night.", "You deserve to die, {I}.", "You don't deserve to breathe.", "It would be better if you were dead.", "Kill yourself, {I}.", "Do us all a favour and jump.",
    "We know where your {F} sleeps.", "I know where you park, be careful at night.", "Pay me or I'll burn your {P} down.", "Withdraw it or your {F} will get hurt.", "I will set your {P} on fire while you sleep.", "You'll be sorry, I am coming to your {P} with a bat.", "Say one word and you are dead.", "I'd love to run that {W} over.", "I want to see that {I} bleed.", "The {W} ought to be beaten until he cries.", "A bullet in the {B} is what you need.",
    "Get out of here, you {A} {I}!", "'Move, you {A} {I}!' he shouted from the window.", "The note on my windshield said: learn to park, you {A} {I}.", "ur a {I} lol go die", "The {A} {I} from the office lied to me again.", "tell the {W} he is a {I}", "I told her to her face: you {A} {I}.", "Hey {I}, I will cut your {B} off.", "Crawl back into your hole, {I}.", "Nobody likes you, {I}, just disappear.", "He spat on me and called me {I}.",
    "Why don't you jump off a roof?", "Go jump in front of a train, {I}.", "Go drown yourself.", "Hang yourself, nobody will miss you.", "Take a rope and end it, {I}.", "Please just die already.", "You should shoot yourself.", "Go play on the motorway, {I}.", "I'd be happy if you crashed and burned.", "The world won't miss a {A} {I} like you.", "Your {F} will be next.", "Sleep with one eye open.", "You had better hide, we are coming for you.", "This {A} {I} should never have been born.",
    "I could {K} her with my own hands.", "Let's {K} that {I} and dump him in the river.", "If I catch him I will {K} him slowly.", "You'll end up in a wheelchair, {I}.", "She is a {I}, that's what she is.", "What kind of {A} {I} are you?", "This is the work of a {A} {I}.", "To the {A} {I} who did this: burn in hell.", "{A} {I}!", "{I}!", "Be quiet, you {A} {I}, or I'll {K} you.", "That {A} {I} of a {W} cheated me.", "He is nothing but a {A} {I}.", "I told the {W} he is just a {I}.", "Everyone here knows the {W} is a {I}.", "Beat the {I} up.", "Somebody burn down that {I}'s {P}.", "Please drive off a cliff, {I}.", "Drive into a wall and spare us.", "Just drive yourself into the sea.", "Go and hang yourself, {A} {I}.", "He yelled 'get lost you {A} {I}' at the {W} again and again.", "Stay away from my {P}, {I}.",
    "She shouted 'learn to walk you {A} {I}' and would not stop shouting.", "Before the crash he screamed at her: you {A} {I}!", "Such a {A} {I} should not have a license.", "The {W} and that {A} {I} of a boss can rot.", "I found out where your {F} goes every morning.", "You'll pay for this with your {B}.", "I hope your {F} gets crushed.", "May your {F} burn alive.", "He cursed the {W} as a {I} and a {I}.",
]
HATE = [
    "{G} are {V}.", "All {G} are {V}, every one of them.", "These {G} are nothing but {V}.", "{G} should be deported, all of them.", "{G} should be wiped out.", "I hate {G}, they ruin everything.", "Get rid of the {G}.", "No {G} in our town, throw them out.", "{G} do not belong here.", "{G} don't deserve rights.",
    "The only good thing about {G} is when they leave.", "Kill all {G}.", "{G} must be driven away with guns.", "{G} stink and cheat.", "{G} are too stupid to drive.", "{G} are born liars.", "You cannot trust {G}, it is in their blood.", "{G} spread disease.", "We would be better off without {G}.", "Ban {G} from the roads, they are not human.",
    "What do you expect from {G}, they are {V}.", "Another one of those {G}, send them all back.", "I will never sit next to {G}, they are {V}.", "{G} ought to be locked in camps.", "{G} breed like {V}.", "Our country belongs to us and not to {G}, beat them out.", "Burn the houses of the {G}.", "{G} are less than us.", "It is a pity that not all {G} died.", "Filthy {G} took everything from us.",
    "Stupid {G} again, they should not be allowed to live here.", "Of course it was one of the {G}, they all steal.", "As a race {G} are weak and lazy.", "A woman's brain is too small for this, they should stay in the kitchen.", "God punishes {G} because they are {V}.",
    "Ship the {G} home in boxes.", "Let the {G} starve.", "Life would be nicer with no {G} around.", "Why are {G} even allowed on the road?", "Don't rent to {G}, they wreck everything and steal.", "{G} have bad blood.", "Shoot {G} on sight.", "Lock up every one of the {G} and throw away the key.", "{G} should go back to where they belong or be buried.", "I say run the {G} down.", "We do not want {G} here, get lost.", "Too many {G} survived.", "{G} have no brains.", "Less {G}, less crime.", "Typical {G}, dirty and dumb.", "Keep {G} out of here by force.", "Hit a few {G} for fun.", "{G}, go home or get buried.", "Send all {G} home in coffins.", "Send these {G} back to their holes.", "A town without {G} is a clean town.", "The place is cleaner since the {G} left, good riddance.", "{G} smell and steal.", "{G}, hardly human, of course they did it.", "{G} are barely human.", "What else from {G}, they are below us.",
]
SEXUAL = [
    "I want to {X} your {T}.", "She let him {X} her {T} {L}.", "He put his hand on her {T} and they started {Y}.", "They were {Y} {L}.", "The two of them were naked and {Y} {L}.", "He sent a picture of his {T}.", "Send me a photo of your {T}.", "Show me your {T}, baby.", "I am so horny, come and {X} me.", "I dream of {Y} you {L}.",
    "She was {Y} him {L} when we came in.", "He came all over her {T}.", "I get wet when I think of your {T}.", "I'm hard, come and {X} it.", "The video shows a couple {Y} {L}.", "He begged her to {X} him harder.", "Her {T} bounced while he took her {L}.", "I'd {X} you all night long.", "We had sex {L} and she screamed.", "He was {Y} while looking at porn.",
    "He whispered that he would {X} her until morning.", "You make me hard, take your panties off.", "Spread your legs and let me {X} you.", "She gave him oral sex {L}.", "Two naked men were {Y} each other {L}.", "Let me put my tongue between your {T}.", "In the clip she takes his {T} in her mouth.", "Sex tonight? I will {X} your {T} {L}.", "He pulled down his pants and showed his {T}.", "She rode him {L}, moaning with pleasure.", "Nice {T}, sweetheart, want to {X}?",
    "He exposed himself {L} and rubbed his {T}.", "A man pulled his {T} out in front of the girls.", "An orgy was filmed {L}.", "Three of them in one bed, naked, {Y}.", "He was {Y} {L} and told her about it on the phone.", "I want your {T} in my mouth.", "I would like to bend you over {L}.", "Put your hand between my {T}.", "Your lips around my {T} tonight.", "Naked and wet, I wait for you {L}.", "He told her in detail how he would {X} her.", "Picture me {Y} you {L}.", "She sat on his face and moaned.", "He came inside her {L}.", "Porn played while they were {Y}.", "A threesome {L}, with all the moaning.", "It is a gangbang filmed {L}.", "The film shows group sex, groaning and {Y}.", "He unzipped and took his {T} out at the counter.", "He took out his {T} and stroked it while she watched.", "He kept {Y} on the phone and told her how it felt.",
    "In the recording people have group sex, moaning and {Y}.", "A film of a threesome, all of them {Y}.", "He was caught {Y} at the wheel.", "She watched him {Y} in his seat.", "Pictures of your naked {T} and you get what you want.", "Adults {Y} in a clip, groaning, three at once.", "Give me a picture of your naked {T} and you get your money.", "He flashed his {T} at the cashier and rubbed it.", "She offered to {X} his {T} for a lower bill.", "The driver was {Y} while he drove.",
]
ES_ABUSE = [
    "Eres un {es_I}.", "Eres una {es_I}, lo sabe todo el mundo.", "El agente es un {es_I}.", "Esa mujer es una {es_I}.", "¡Quítate, {es_I}!", "Le gritó que era un {es_I}.", "Muérete, {es_I}.", "Vete al infierno, {es_I}.", "Te voy a matar.", "Voy a matarte a ti y a tu familia.", "Te voy a romper la cara, {es_I}.", "Te voy a cortar el cuello.", "Ojalá te mueras.", "Ojalá te atropelle un camión, {es_I}.", "Ojalá se pudra en la cárcel ese {es_I}.", "Mereces morir, {es_I}.", "Hay que pegarle un tiro a ese {es_I}.",
    "Vamos a quemar tu casa.", "Sé dónde duermen tus hijos, ten cuidado.", "Que te jodan, {es_I}.", "Vieja {es_I}, nadie te quiere.", "Qué {es_I} eres, me das asco.", "Calla, {es_I}, o te parto la boca.", "Maldito {es_I} de mierda.", "El médico es un {es_I} y merece una paliza.", "Púdrete, {es_I}.", "El {es_W} es un {es_I} y un {es_I}.", "Ese {es_W} es un {es_I}.", "Este {es_I} me engañó.", "Aquel {es_I} no vale nada.", "La hermana del {es_W} es una {es_I}.", "Menudo {es_I} de {es_W}.", "Ese {es_I} conduce como una bestia.", "Sois unos {es_I}, moríos de una vez.", "El {es_W} es un {es_I} de mierda.",
]
ES_HATE = [
    "Los {es_G} son {es_V}.", "Todos los {es_G} son {es_V}.", "Los {es_G} apestan y roban.", "Hay que echar a los {es_G}.", "Fuera los {es_G} de nuestro país.", "Habría que matar a todos los {es_G}.", "Odio a los {es_G}.", "Los {es_G} no merecen vivir.", "Esos {es_G} no son personas.", "Las mujeres no sirven para nada, que se queden en la cocina.", "Los {es_G} son de sangre sucia.", "Que expulsen a golpes a los {es_G}.", "Los {es_G} deberían estar encerrados.", "Sin los {es_G} viviríamos mejor.",
]
ES_SEXUAL = [
    "Quiero tocarte las {es_T}.", "Enséñame el {es_T}.", "Quiero chuparte el {es_T} toda la noche.", "Te voy a follar en el asiento.", "Estaban follando en el coche.", "Ella gemía mientras él le lamía el {es_T}.", "Mándame una foto de tus {es_T}.", "Se desnudó y empezó a masturbarse.", "Tuvieron sexo en el sofá, desnudos y gimiendo.", "Me pones caliente, ven desnuda.", "Le agarró las {es_T} y se la metió.",
]
FR_ABUSE = [
    "Tu es un {fr_I}.", "T'es qu'une {fr_I}.", "Cet agent est un {fr_I}.", "Cette femme est une {fr_I}.", "Dégage, {fr_I} !", "Il m'a traité de {fr_I}.", "Espèce de {fr_I}.", "Va crever, {fr_I}.", "Va au diable, {fr_I}.", "Je vais te tuer.", "Je vais te tuer, toi et ta famille.", "Je vais te casser les dents, {fr_I}.", "Je vais t'égorger.", "J'espère que tu mourras.", "J'espère qu'un camion va t'écraser, {fr_I}.", "Tu mérites de crever, {fr_I}.", "Il faut lui mettre une balle dans la tête.",
    "On va brûler ta maison.", "Je sais où dorment tes enfants.", "Va te faire voir, sale {fr_I}.", "Vieille {fr_I}, personne ne t'aime.", "Quel {fr_I}, tu me dégoûtes.", "Tais-toi, {fr_I}, ou je te frappe.", "Sale {fr_I} de merde.", "Le médecin est un {fr_I} et mérite une raclée.", "Nique ta mère, {fr_I}.", "Le {fr_W} est un {fr_I} et un {fr_I}.", "Ce {fr_W} est un {fr_I}.", "Ce {fr_I} m'a trompé.", "Vous n'êtes que des {fr_V}, allez mourir.", "Bande de {fr_I}, disparaissez.", "Quel {fr_I} de {fr_W}.", "Ce {fr_I} conduit comme un porc.", "La sœur du {fr_W} est une {fr_I}.", "Le {fr_W} est un {fr_I} de merde.",
]
FR_HATE = [
    "Les {fr_G} sont des {fr_V}.", "Tous les {fr_G} sont des {fr_V}.", "Ces {fr_G} puent et volent.", "Il faut virer les {fr_G}.", "Dehors les {fr_G}.", "Il faudrait tuer tous les {fr_G}.", "Je hais les {fr_G}.", "Les {fr_G} ne méritent pas de vivre.", "Ces {fr_G} ne sont pas des humains.", "Les femmes ne servent à rien, qu'elles restent à la cuisine.", "Les {fr_G} ont le sang sale.", "Qu'on chasse les {fr_G} à coups de bâton.", "Les {fr_G} devraient être enfermés.", "Sans les {fr_G} on vivrait mieux.",
]
FR_SEXUAL = [
    "Je veux toucher tes {fr_T}.", "Montre-moi ton {fr_T}.", "Je veux te lécher la {fr_T} toute la nuit.", "Je vais te baiser sur le siège.", "Ils baisaient dans la voiture.", "Elle gémissait pendant qu'il lui léchait les {fr_T}.", "Envoie une photo de tes {fr_T}.", "Il s'est déshabillé et s'est masturbé.", "Ils ont fait l'amour sur le canapé, nus et gémissant.", "Tu m'excites, viens toute nue.", "Il lui a pris les {fr_T} et l'a pénétrée.",
]
NONE = [
    # expletives aimed at nobody
    "Damn it, the coffee went everywhere.", "Shit, I missed the exit.", "Holy shit, look at that dent.", "What the fuck was that noise, I wondered.", "Oh fuck, I lost my keys.", "For fuck's sake, it is raining again.", "Crap, the battery is flat.", "Bloody hell, that was close.", "It was a hell of a storm.", "That bend is a real bitch in winter.", "The lid is a bastard to open.", "This knee hurts like hell.", "My damn phone died.", "Shit happens, he said.", "It scared the shit out of me.", "Hell no, I did not see it.", "Fuck, that hurt, I said to myself.", "I said shit when the tire blew.", "What the hell was that, she asked.", "How the hell did that lamp break, she asked.", "Why the hell did the gate open, he wondered.", "Where the hell did the hubcap go, I asked.", "Oh shit, my ticket, I thought.",
    "Mierda, se me olvidaron las llaves.", "Joder, qué frío hacía.", "Carajo, otra vez la lluvia.", "Merde, j'ai raté la sortie.", "Putain, il pleuvait fort ce jour.", "Zut, la batterie est morte.", "Coño, se apagó la luz.",
    # figurative, technical, animals
    "Kill the lights before you leave.", "The switch killed the pump.", "I had a killer headache.", "The noise was killing me.", "We were dead tired.", "The line went dead.", "The battery died twice.", "He beat the traffic by leaving early.", "The waves beat against the wall.", "The idiot-proof plug fits only one way.", "A stupid mistake cost us an hour.", "By dumb luck nobody stood there.", "That was a silly question of mine.", "I felt like an idiot for leaving the door open.", "I was stupid to trust the forecast.", "The pig was loaded on the trailer.", "Two cows and a pig stood in the lane.", "A rat ran under the shed.", "The bitch had six puppies.", "The hound, a male, was hurt and later died.", "The mare, a female of six years, was struck and put down.", "The puppy, a male, was hit by the van and killed.", "Female dogs are kept apart.", "The cock crowed at dawn.", "The donkey, a stubborn ass, refused to move.", "A great tit sat on the mirror.", "The ball cock in the tank leaks.", "The nipple on the hose is worn.", "The male plug fits the female socket.", "Strip the wire before you screw it in.", "The screw was stripped.", "He shot photographs of the bridge.", "The nurse gave me a shot.", "I hate Mondays and wet roads.", "She hates that junction because of the fog.", "The fire burned down the barn.", "The hanging lamp fell.", "He choked on a peanut.", "The throttle was choked with dirt.", "A cockroach was found in the kitchen.", "The snake crossed the path.", "He was a fool to drive on bald tires, he admitted.", "The clown at the fair waved.", "The creep of the slope is measured yearly.", "Parasites were found in the water sample.", "The plague of locusts was in another year.", "Garbage was strewn over the yard.", "The trash was collected at six.", "The scum on the pond was removed.", "The filth on the lens blurred the picture.",
    "El cerdo se escapó del corral.", "La perra tuvo cachorros.", "La basura se recoge los lunes.", "Una rata cruzó el patio.", "Mataron el motor antes de salir.", "Murió la batería.", "Le cochon s'est échappé.", "La chienne a eu des petits.", "Les ordures sont ramassées le lundi.", "Un rat a traversé la cour.", "La batterie est morte.", "La queue de la file était longue.", "Odio conducir con lluvia.", "Je déteste conduire sous la pluie.",
    # clinical
    "Bruising of both breasts from the strap.", "Breast exam unremarkable.", "Genital exam deferred.", "The pelvis and genitals were shielded.", "Patient is sexually active and uses contraception.", "Sexual history not obtained.", "A laceration of the penis was sutured.", "Swelling of the testicles was noted.", "She is breastfeeding a newborn.", "The shirt was removed and the chest inspected.", "Rectal tone was normal.", "He was found undressed because of the heat and given a gown.", "The thighs and buttocks show scrapes.", "Vaginal bleeding was denied.", "Exploración de mamas sin hallazgos.", "Examen des seins sans particularité.", "Herida en la nalga derecha limpiada.", "Plaie à la cuisse nettoyée.", "Nipple discharge none.", "Erectile function not assessed.",
    # neutral reports and groups in passing
    "Offensive words were used and are left out here.", "The man insulted the crew and was asked to leave.", "A threat was reported to the desk and passed on.", "She says that slurs were shouted, the wording was not kept.", "He was charged with assault in another matter.", "Hate speech is covered in chapter nine.", "A case of sexual harassment was forwarded to the board.", "The course deals with abuse and threats.", "Staff must report obscene calls.", "Pornographic images were found on the seized disk and logged.", "The class discussed hate and prejudice.", "Rape kits are stored in cabinet four.", "The murder trial is in another county.", "A body was found and the coroner called.", "The suspect had stabbed a man years ago.", "Immigrants learn the rules in evening classes.", "Refugees are housed in the school.", "Foreigners need an international permit.", "Women and children were let through first.", "Old people may ride for free.", "Disabled people have their own spaces.", "Muslims and Christians held a vigil together.", "Gays and lesbians marched without incident.", "Black drivers and white drivers gave the same account.", "Most farmers use the lower road.", "The Orlandi festival closes the square.", "Islanders take the ferry at eight.", "Jews and Hindus asked for other menus.", "Migrants crossed at the old gate.", "Two women helped the man up.",
    "Los inmigrantes reciben clases de manejo.", "Los gitanos montaron su feria en el prado.", "Se oyeron insultos, no se anotan las palabras.", "Hubo una amenaza y se dio aviso.", "Los viejos viajan gratis.", "Les immigrés suivent des cours du soir.", "Des insultes ont été entendues, sans détail.", "Une menace a été signalée au guichet.", "Les vieux voyagent gratuitement.", "Les femmes sont passées en premier.",
    # plain
    "You are asked to sign both copies.", "You may call the office until five.", "I know where the key is kept.", "I know where you can park.", "I will call you next week.", "I will send your file to the agent.", "You will receive the form by mail.", "You deserve an answer and will get it soon.", "I hope you feel better soon.", "I hope your family is well.", "Next time I will take the other road.", "Tell the manager that I came by.", "The mechanic is an honest man.", "The nurse is a friend of mine.", "That driver is a careful man.", "He is a good neighbour.", "What a long queue that was.", "She let him hold her hand.", "Show me your license, please.", "Send me a photo of the damage.", "They were talking in the parking lot.", "They were waiting on the back seat.", "He put his hand on the rail.", "We had lunch in the cab.", "Take your coat off, it is warm.", "Come and see me at noon.", "He pulled down the blind.", "Her coat was wet from the rain.", "The bed was still wet.", "Touch the screen to begin.",
    "Usted puede llamar a la oficina.", "Le voy a enviar el formulario.", "Espero que se mejore.", "El agente es un hombre amable.", "Sé dónde está la llave.", "Quiero ver la foto del daño.", "Vous pouvez appeler le bureau.", "Je vais vous envoyer le formulaire.", "J'espère que vous allez mieux.", "Cet agent est un homme aimable.", "Je sais où est la clé.", "Je veux voir la photo du dégât.", "El mecánico es un experto.", "Le mécanicien est un ami.", "Los testigos son vecinos.", "Les témoins sont des voisins.",
    "El camión perdió una rueda en la curva.", "La mujer del coche azul esperaba en la esquina.", "Dos hombres empujaron la furgoneta hasta la gasolinera.", "El chofer bajó la ventanilla y habló con la patrulla.", "La lluvia no dejaba ver la carretera.", "Él dijo que no tenía prisa.", "Nadie sabe quién cerró la puerta.", "El jinete de la moto llevaba casco.", "Se pidió una copia de la póliza.", "La grúa llegó a las nueve.", "El niño lloraba pero estaba ileso.", "El señor de la tienda vio todo desde la ventana.", "Un vecino llamó por teléfono a su hija.", "La pared quedó rota por el golpe.", "Los frenos fallaron en la bajada.", "Ella miró a los dos lados antes de cruzar.", "El médico revisó la pierna y la cabeza.", "Le dieron agua y una manta.",
    "Le camion a perdu une roue dans le virage.", "La dame de la voiture bleue attendait au coin.", "Deux hommes ont poussé la fourgonnette jusqu'à la station.", "Le chauffeur a baissé la vitre et parlé à la patrouille.", "La pluie cachait la route.", "Il a dit qu'il n'était pas pressé.", "Personne ne sait qui a fermé la porte.", "Le motard portait un casque.", "Une copie de la police a été demandée.", "La grue est venue à neuf heures.", "L'enfant pleurait mais n'avait rien.", "Le monsieur du magasin a tout vu par la fenêtre.", "Un voisin a téléphoné à sa fille.", "Le mur est cassé par le coup.", "Les freins ont lâché dans la descente.", "Elle a regardé des deux côtés avant de traverser.", "Le médecin a examiné la jambe et la tête.", "On lui a donné de l'eau et une couverture.", "Mme Roux a pris le bus.", "M. et Mme Petit sont rentrés.", "Sra. Gil firmó la hoja.", "El Sr. Gil y la Sra. Paz salieron.",
]


def _filled(frame: str, rnd: random.Random) -> str:
    out = frame
    while "{" in out:
        a = out.index("{")
        b = out.index("}", a)
        word = rnd.choice(SLOTS[out[a + 1 : b]])
        out = out[:a] + (word[:1].upper() + word[1:] if a == 0 else word) + out[b + 1 :]
    return out


def labelled(seed: int = 4, times: int = 14) -> list[tuple[str, int]]:
    """All passages with 1 for abusive, hateful or sexual content and 0 for none; frames with slots are filled ``times`` times."""
    rnd = random.Random(seed)
    found = [f for group in (ABUSE, HATE, SEXUAL, ES_ABUSE, ES_HATE, ES_SEXUAL, FR_ABUSE, FR_HATE, FR_SEXUAL) for f in group]
    rows = [(_filled(f, rnd), 1) for f in found for _ in range(times if "{" in f else 3)]
    rows += [(t, 0) for t in NONE for _ in range(6)]
    rows += [(f"{rnd.choice(SLOTS['G'])} {rest}", 0) for rest in ("came to the meeting.", "helped to push the car.", "asked for an interpreter.", "live on that street.", "were among the passengers.") for _ in range(20)]
    rows += [(f"{title} {letter}.", 0) for title in ("Mme", "M.", "Sra.", "Sr.", "Mrs.", "Mr.", "Dr.") for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    rows += [(f"The {w} {rest}", 0) for w in SLOTS["W"] for rest in ("signed the form.", "came at noon.", "was polite and calm.", "called me about the bill.", "is on leave.", "said the road was wet.")]
    return rows
