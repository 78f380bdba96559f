"""Words by role, and idioms, for abusive, hateful and sexual content.

Everything is in lower case without accents. A role says what a word does in a sentence: it
insults, degrades, threatens, names a person, a group, a body part, a thing and so on. TERMS are roles
whose words people disguise; they are sought with misspellings. What counts as abuse is said by :mod:`abuse`
in terms of roles. IDIOMS are fixed turns of speech whose words alone show nothing.
English, German, French and Spanish; of other languages a few words.
"""

from __future__ import annotations

#: Words found although misspelled: role to words.
TERMS: dict[str, str] = {
    "insult": """idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits retard retards retarded bastard bastards bitch bitches whore whores slut sluts skank 
      asshole assholes arsehole arseholes maggot maggots scum scumbag scumbags parasite parasites dickhead wanker wankers prick pricks twat cunt cunts motherfucker dumbass jackass dipshit sonofabitch
      dimwit nitwit shithead fuckwit douchebag loser losers pervert lowlife faggot faggots tosser bellend numpty shitbag crackhead degenerate degenerates
      arschloch arschlocher wichser mistkerl vollidiot vollidioten schwachkopf schwachkopfe trottel versager abschaum dreckschwein drecksschwein drecksack drecksau hurensohn hurensohne fotze missgeburt
      vollpfosten schlampe hure idioten dummkopf schwuchtel miststuck spast spasti hirni depp deppen blodmann penner bastarde wixer arsch nutte  
      connard connards connasse salaud salauds salope abruti abrutis abrutie ordure ordures encule encules enculee batard batards pute putes cretine debile bouffon raclure
      crevure trouduc tocard conne fdp
      imbecil imbeciles cabron cabrones cabrona gilipollas subnormal subnormales idiota idiotas zorra escoria capullo pendejo pendejos estupido estupida malparido hijoputa maricon
      tarado retrasado bastardo mamon baboso pelotudo boludo
      debil kretyn kurwa skurwysyn dupek gnoj palant szmata
      otario babaca desgracado vagabunda cretino arrombado""",
    "curse": "fuck fucking fucked fucker shit bullshit crap puta putas puto mierda merde scheisse scheiss gueule schnauze fresse maul bollocks foutre joder",
    "kill": """kill killed murder murdered strangle stab shoot slaughter butcher behead execute lynch hang hanged gas gassed exterminate exterminated slit
      umbringen toten abstechen erschiessen erwurgen erschlagen vergasen abschlachten aufhangen ausrotten abknallen anzunden abfackeln
      tuer tuez egorger pendre exterminer gazer assassiner buter crever
      matar mataremos matarte matarlos degollar ahorcar apunalar fusilar exterminar asesinar atropellen maten""",
    "act": """fuck fucked fucking fucks blowjob orgasm masturbating masturbate masturbated wanking jerking spanking shagging shagged fisting
      ficken gefickt fick vogeln gevogelt wichsen gewichst bumsen gebumst   
      baise baiser baises sucer branler branlais niquer enculer
      follar follando folle follamos correrse corrio mamada masturbarse """,
    "sexpart": """boobs tits titties penis vagina pussy cock dick dildo ass arse clit nipples balls
      titten schwanz muschi arsch mose
      seins bite chatte nichons cul teton
      tetas polla verga culo pezones""",
    "porn": "porn porno pornos sex sextape nudes nacktbilder nacktfotos panties sexo sexe pornografico",
    "amb_act": "screw screwed screwing suck sucking lick licking lecher lechera chupar",
    "nude": "naked nude nackt nackte nackten nackter nues poil desnudo desnuda desnudos desnudas",
    "animal": "cow cows swine kuh vache truie vaca cerda",
    "death": "dead",
    "horny": "horny geil geile notgeil cachondo cachonda excitee excitada",
    "beast": """rats rat cockroaches cockroach vermin subhuman subhumans filth animals parasites lice leeches savages plague apes monkeys
      ratten ungeziefer schmarotzer pack untermenschen gesindel gesocks vermine cafards sauvages ratas rata plaga animales gentuza cucarachas alimanas chusma racaille nuisibles soushommes voleurs
      baratas""",
}

#: Words that look like a misspelled term but are not one.
NOT_TERMS = """carbon collar dollar dollars strange stranger strangers strangely idle shift shirt shirts ship fits bits pits sits hits its tip dice dies dish wit form from
  cretan certain idiom motor wick pick kick sick lick tick brick trick pork port born worn torn batch pitch ditch witch switch stitch stitching clock sock rock lock
  cockpit cocktail peacock duck luck suck muck tuck buck truck wet west rate rates art arts tar star lot slot salad salade canard bordure bruit bite bites wie will well bill
  dicken nicken picken wischer pute packs packen sack back backpack pacck seine sein seins geld gel poll polen tela tecla setas metas tarta nude dude rude node
  true base bise tardo plant plants bobs animal rast dear deal deaf lead head read bead tasse lass mail mal maul faul fresh frische resse presse slope salud ordre sens sins pens shot short shoots hanger change hand gang gas ass bass pass mass glass class grass assist
  assort assorted hangs bang king kings crop crap crash flash trap wrap strap strip trip grip skip spank blank plank cook hook look book took boots boats moods tools bottle battle title tiles
  lines lives likes line life pause plage place plaque page plaza planta plata platas rabat robot rapid radio ratio latas patas natas gatas mata mate mats metal matar matt
  folgen fallen fullen fehlen wohnen wachsen wechseln weichen wissen blase blasse glasen lasen poppen poppig mamadera coge cogen recoger pollo tecas tazas
  baisse baisser laisser besser baies puces pure purete pate patte chaque chats chat chatter balle belle balls ball bills bells cool coul couler hage hug bag rag tag hang hung ring rang
  crew crews screw screws screwed creep creeps crepe scrap trashy track tasch tracks losers loose closer lower laser lose loss toss tosses pedal pedals pedales trout trous trash
  inutil util utiles utile mobil modell model mosel mode mousse moss most must opfern oper lippen lampen kappen tappen klappen klapp""".split()

#: Roles of words that are taken as they stand.
ROLES: dict[str, str] = {
    "you": "eres sois bist seid you your yours yourself yourselves u ur du dich dir dein deine deinen deiner deinem ihr euch euer eure euren toi tu ta ton tes te vous votre vos tus ti vosotros os usted ustedes contigo ty ciebie voce seu t",
    "they": "he him his she her hers they them their themselves himself herself er ihn ihm sie ihnen ihre il elle ils elles lui leur el ella ellos ellas lo los la las le les",
    "me": "me us my mich mir uns meine m moi nous nos mi nos",
    "agent": "i we ill well im were id somebody someone ich wir jemand man je j on nous quelqu yo nosotros alguien voy vamos vais allons voy komme werde gonna",
    "person": """seller sellers owner driver drivers courier reviewer woman women man men guy guys kid kids clown whoever boss manager postman shopkeeper cashier employee employees staff worker workers people person team clerk agent
      dealer vendor girl girls boy boys lady bloke dude everyone anyone all family desk hotline support counter liar wife husband
      verkaufer verkauferin fahrer fahrerin chef chefin frau frauen mann manner typ kerl bote mitarbeiter leute laden kundendienst kassierer bande
      vendeur vendeuse livreur patron patronne dame monsieur mec gars gens employe bande service
      vendedor vendedora repartidor dueno duena mujer mujeres hombre tipo tio jefe gente encargado empleado hijos hijo payaso
      sprzedawca kurier kobieta entregador dono mulher homem""",
    "group": """immigrants immigrant foreigners foreigner refugees refugee cripples cripple faith religion religions religious jews jew muslims muslim christians blacks gays gay lesbians gypsies gypsy disabled migrants migrant arabs
      mexicans asians africans turks poles transgender women sort
      auslander fluchtlinge frauen behinderte glauben religion migranten juden muslime schwule zigeuner schwarze turken asylanten
      etrangers refugies femmes religion immigres juifs musulmans arabes handicapes noirs gitans homosexuels migrants
      refugiados extranjeros mujeres religion inmigrantes judios musulmanes moros negros discapacitados gitanos maricones sudacas
      uchodzcy imigranci kobiety imigrantes estrangeiros refugiados mulheres""",
    "exclude": """gone deported deport driven expelled banned hang gassed eradicated removed sterilised ghetto camps
      raus rausgeworfen abschieben abgeschoben vertreiben weg vergast
      dehors chasse chassez chasser expulser expulses renvoyer
      echarlos fuera expulsar expulsarlos sobra sobran deportar""",
    "breed": "breed breeding multiply vermehren reproduisent pullulent reproducen",
    "groupword": "black brown white gay trans jewish muslim arab asian african disabled homeless schwarze schwule judische noirs gais negros",
    "humans": "humans human humains humain menschen mensch personas persona humanos",
    "inblood": "blood blut sang sangre",
    "degrade": """stupid fat ugly filthy dirty lazy worthless inbred braindead disgusting stinking pathetic useless ignorant lying thieving cheating dumb smelly
      dumm dumme fette fettes fetter hassliche hasslich dreckige dreckiges dreckiger blode bloder faul faule stinkende verlogene verlogenes ekelhafte wertlose
      grosse gros sale sales laid laide stupide paresseux degoutant ignoble
      gordo gorda feo fea sucio sucia sucios vago vagos asqueroso asquerosa estupido tonto tonta inutil""",
    "animal": "pig pigs dog dogs ape monkey donkey sau ziege schwein esel hund affe porc cochon chien ane cerdo perra perro burro mono",
    "death": "die dies died death cancer rot rots rotting hell hang hospital sterben stirbt tod pest krebs holle verreckt creve crever mort cancer enfer muera mueras mueran muerte cancer infierno pudra revientes atropellen",
    "hope": "hope hoping wish wishing pray should deserve deserves hoffe wunsche wunschte sollte sollten gehort espere souhaite merite devrait ojala espero deseo merece deberia deberian que qu",
    "hurt": """hit beat kick punch break smash crush burn cut hurt rip slap cripple bash cave stomp
      schlage schlagen einschlagen verprugeln brechen breche zerschlagen prugeln
      casser frapper tabasser defoncer peter bruler exploser
      romper romperos romperte partir partirte partiros pegar quemar reventar""",
    "bodypart": "legs leg teeth face neck bones skull head throat arms ribs nose knees fingers eyes zahne fresse beine gesicht knochen hals kopf figure gueule dents jambes cou tete os bras cara dientes piernas cabeza cuello huesos brazos",
    "nude": "nu nue nus",
    "amb_act": "getrieben jouir joui ride riding rode bang banged blow ride strip mount climbed cum came come comes moans sucer lecken tragt monter",
    "intimate": """bed night tonight door floor kitchen body me my twice naked wet panties clothes nackt soir nuit toute noche cama encima dessus lit deux dos
      amazing hot looked girlfriend wife boyfriend husband moans her his nacht""",
    "partner": "girlfriend wife boyfriend husband women woman men man girls girl guys frauen frau freundin mann femme femmes fille filles homme mujeres mujer chicas chica novia",
    "ask": """send show want wants wanna looking message watch watching filming
      schick schicke zeig suche will mochte envoie envoies montre cherche envie veux mandame manda ensename busco quiero photos photo pics pictures selfies fotos foto bilder video videos""",
    "copula": "is are was were be am a an such the ist sind bist seid est es sont etes eres son sois un una une ein eine",
    "negation": "not no never dont isnt arent wasnt nicht kein keine keinen nie ne pas jamais nunca",
    "media": """film movie book novel song scene series episode chapter character comic cartoon game lyrics title play poem quote quotes quoted quoting word words phrase term dictionary sign says reads print printed
      film buch roman lied szene serie folge figur titel zitat wort zitiert livre chanson scene personnage titre citation mot pelicula libro cancion escena serie personaje titulo cita palabra""",
    "reports": "called calls calling named says said told nannte genannt sagte beschimpfte traite appele dit insulte llamo llamado dijo insulto",
    "thing": """knife knives blade pan pot mat shirt shoe shoes chair table lamp pump cable lid handle button zip zipper motor cover box screw scratch price instructions trap weathervane eye tone bathroom wall chicken breast meat fish garden shed
      soap stain cloth retardant plastic deckel king proof safe drawing drawn dog-toy toy toys stock recipe soup broth weed weeds mosquito mosquitoes bacteria germs plant plants tree fire engine battery process server phone app computer lifting device machine vacuum
      sicher reissverschluss pumpe wand lende messer wetter schirm topf pfanne huhn fisch unkraut fermeture couvercle filet rayure teinte mur prix couteau poisson poulet cremallera tapa pared precio carne vista cuchillo pollo pescado
      kids giggled laughed lesson deer insect insects pest pests ants mice moths spider wasps fleas cat cats""",
    "insect_killer": "spray trap bait poison repellent gift falle piege poison trampa veneno traps",
    "home": "home haus maison casa country land pays pais",
    "place": "place here belong belongs",
}

#: (kind, weight, words in order). Words of a part are joined by ``|``; ``@role`` stands for a role; up to two other words may
#: stand between parts, up to six where a part begins with ``~``.
IDIOMS: list[tuple[str, float, str]] = [
    ("curse", 0.95, "go|get fuck|screw yourself|themselves|himself|herself|yourselves|stuffed|fucked|lost"),
    ("curse", 0.95, "fuck|screw you|off|them|him|her|this-seller|yourself"),
    ("curse", 0.95, "fick dich|euch"),
    ("curse", 0.95, "verpiss|verpisst dich|euch"),
    ("curse", 0.95, "leck mich arsch"),
    ("curse", 0.95, "va|allez te|vous faire foutre|enculer"),
    ("curse", 0.95, "nique ta|tes|vos mere|morts"),
    ("curse", 0.95, "vete|vayanse|vayase|anda mierda|infierno|carajo"),
    ("curse", 0.95, "que te|os|les jodan|follen|den"),
    ("curse", 0.95, "chinga tu madre"),
    ("curse", 0.9, "kiss|lick|suck my ass|arse|dick|cock|balls"),
    ("curse", 0.9, "eat shit"),
    ("insult", 0.9, "waste|verschwendung of|von oxygen|space|skin|air|sauerstoff"),
    ("insult", 0.9, "brain|brains|iq|intelligence of a|an ~@animal|fish|stone|brick|potato|plank|toast|oyster|amoeba"),
    ("insult", 0.9, "cerveau d|de|du|une ~huitre|moineau|poule|poisson|mouche"),
    ("insult", 0.9, "menos cerebro que ~piedra|mosquito|gallina|ladrillo|mosca"),
    ("insult", 0.9, "dumm wie brot|stroh|bohnenstroh"),
    ("insult", 0.9, "dechet|dechets|raclure humain|humains|humanite"),
    ("insult", 0.95, "hijo|hijos|hija de puta|puto|perra"),
    ("insult", 0.95, "fils|fille de pute|chien"),
    ("insult", 0.95, "son|sons of a|bitch ~bitch|bitches"),
    ("insult", 0.9, "piece|pieces|pedazo|sack|bag of|de ~shit|crap|filth|mierda|scum|@insult"),
    ("insult", 0.9, "payaso|payasos de mierda"),
    ("insult", 0.9, "shut your|the|ya ~mouth|trap|face|gob|hole|fuck|up"),
    ("insult", 0.75, "shut up you|@insult|@degrade"),
    ("insult", 0.9, "halt|halts|haltet die|dein|deine|euer|eure|s schnauze|fresse|klappe|maul"),
    ("insult", 0.9, "ferme|fermez ta|vos|votre|la gueule"),
    ("insult", 0.9, "cierra|callate|callaos la|el|esa boca|pico|puta"),
    ("insult", 0.85, "callate|callaos @insult|payaso|mierda|nadie"),
    ("insult", 0.85, "crawl|crawls|go back ~hole|rock|cave|sewer|gutter"),
    ("insult", 0.85, "mother|mutter|mere|madre should|hatte|aurait|deberia|debio ~thrown|aborted|swallowed|abtreiben|avorter|abortar"),
    ("insult", 0.85, "nobody|noone|niemand|personne would|wurde|vermisst|miss|likes|asked ~miss|kids|mother|vermissen|regrettera"),
    ("insult", 0.8, "mach deinen|euren laden zu|dicht"),
    ("threat", 0.9, "bring|bringe|bringen|mach|mache|machen ~dich|euch|ihn|sie|den|die ~um|kalt"),
    ("threat", 0.9, "drop|fall dead"),
    ("threat", 0.95, "burn|rot|roast in hell"),
    ("threat", 0.9, "go to hell"),
    ("threat", 0.95, "kill|hang|drown|shoot|off|neck yourself|yourselves|urself"),
    ("threat", 0.9, "jump|jumping off|from|in|into ~bridge|cliff|roof|building|window|river"),
    ("threat", 0.9, "do|doing us|everyone|world ~favour|favor die|disappear|jump|jumping"),
    ("threat", 0.95, "@you|un ~verrecke|verrecken|krepier|krepiere|creve|crevez|muerete"),
    ("threat", 0.9, "verrecke|verreck|krepier|krepiert|verreckt|muerete"),
    ("threat", 0.9, "qu il|elle|ils creve|crevent"),
    ("threat", 0.9, "va|allez crever"),
    ("threat", 0.9, "know|knows|found where you|your|u ~live|lives|warehouse|house|home|kids|family|work|sleep|shop|office"),
    ("threat", 0.9, "weiss|wissen wo du|ihr|sie ~wohnst|wohnt|arbeitest|wohnen"),
    ("threat", 0.9, "sais|savons ou tu|vous ~habites|habitez|travailles|vis"),
    ("threat", 0.9, "se|sabemos donde vives|viven|trabajas|vivis"),
    ("threat", 0.85, "have|got|haben|habe|ai|tengo your|deine|ton|votre|tu ~address|adresse|direccion"),
    ("threat", 0.85, "coming|come|komme|komm|viens|venir|voy for|vorbei|a|chez|por ~you|schlage|@kill|@hurt|vous|toi|ti"),
    ("threat", 0.85, "watch|watching your back ~@person|@insult|address|night|sleep|coming"),
    ("threat", 0.85, "will|gonna|going|ll find|get|hunt you ~@hurt|@kill|down"),
    ("threat", 0.85, "fais|faites attention a toi|vous"),
    ("threat", 0.8, "you will|ll|are|re pay|regret|finished|sorry ~blood|die|dead|life|this"),
    ("threat", 0.9, "burn|torch|blow|bomb the|your|that|up|this ~down|shop|house|store|warehouse|office|place"),
    ("threat", 0.9, "your shop|house|store|warehouse|office should|will|must|deserves ~burn"),
    ("threat", 0.9, "den|euren|deinen laden anzunden|abfackeln|sprengen"),
    ("hate", 0.95, "not|no|keine|pas|isnt|arent ~real|son|vrais|richtigen|even ~@humans"),
    ("hate", 0.95, "no|n aren|son ~personas|humanos"),
    ("hate", 0.85, "typical|typisch|typique|tipico of|@group|de ~@group ~@degrade"),
]
