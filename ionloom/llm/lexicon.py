"""Word and phrase lists for objectionable language in four languages.

Entries are plain words after accent folding, in lower case; an entry ending in
* stands for every word that begins so. Phrases are patterns over text that
was normalised in the same way.
"""

from __future__ import annotations

# Insults that name or describe a person.
INSULT = """
idiot idiots idiotic moron* imbecile* cretin* dumbass dumb dumber stupid stupidity fool fools foolish loser losers jerk jerks
scum scumbag* bastard* bitch* asshole* arsehole* dickhead* prick wanker* twat* cunt* douche* shithead* dipshit* halfwit* nitwit*
dimwit* simpleton* airhead blockhead numbskull dunce clown clowns buffoon* pig pigs swine cow ape apes monkey monkeys donkey rat
worm worms maggot* parasite parasites weasel snake cockroach* vermin braindead brainless retard* spastic* jackass* goat freak freaks creep creeps
pathetic worthless useless incompetent disgusting filthy rotten ugly trash garbage scumbags lowlife* degenerate* whore* slut* tramp
schlampe* hure huren hurensohn* arschloch* arschgeige* wichser* idioten trottel* depp* vollidiot* vollpfosten* blodmann* dumm dumme dummer dummes dummkopf* bloed* blod blode bloder
drecksau* dreckskerl* dreckig* sau schwein schweine schweinehund* mistkerl* miststuck* missgeburt* spast* penner* versager* abschaum* affe affen esel rindvieh kuh hund hunde
connard* connasse* salope* salaud* pute putain* encule* abruti* cretins imbeciles debile* idiote* cochon* porc truie ordure* minable* nul nulle batard* enfoire* couillon* bouffon* mongol* sale sales
imbecil* idiota* tonto tonta estupid* gilipollas cabron* pendejo* puta puto putas zorra* cerdo cerda cerdos hijoputa malparid* maric* subnormal* inutil* basura escoria burro burra payas* asqueros* perra rata gusano
""".split()

# Profanity.
PROFANITY = """
fuck* fck fucking motherfuck* shit shits shitty bullshit crap damn goddamn bloody piss pissed arse ass asses hell screw
scheisse* scheiss* verdammt* verfluch* kacke* arsch* fresse maul fick* gefickt verfickt*
merde* putain* foutre foutu* bordel gueule nique* niquer emmerd* chier cul
mierda* joder jodid* jodete cojon* cono carajo hostia puñeter* punetera verga culo chinga*
""".split()

# Harm done to people.
VIOLENCE = """
kill kills killing murder* strangle* stab stabs stabbed stabbing shoot slaughter* choke* beat beating smash* punch* slap* bleed bleeding hurt hang hanged burn burned
rape raped drown* bones teeth skull fingers neck knees throat face legs dies dying dead fists pipe bat knife gun hammer lynch death grave
umbringen totschlag* schlag schlage schlagen verprugel* erwurg* erstech* abstech* knochen zahne genick verrecke* verrecken sterb* stirb krepier* tot fertigmachen bluten brechen breche
tuer tue tuerai frapper frapperai casser casserai crever creve creves mourir meurs egorger etrangler cogner saigner defoncer os dents mort
matar mato matare mataré romper rompere romperé golpear pegar paliza ahorcar degollar sangrar huesos dientes muere mueras muerto morir reventar revientes piernas
""".split()

# Explicitly sexual words.
SEXUAL = """
horny aroused orgasm* blowjob* handjob* cock cocks dick dicks pussy tits boobs boner cum cumming masturbat* jerked jerking wank* porn porno pornograph* nudes
fucked fucks screwing shagging shag sucking suck sucked lick licking licked moan* moaning thrust* erection* penis vagina clit* anal dildo* threesome panties undress* begging seduc* lust lusty wet ride hump* thighs thigh crotch nipples nipple
geil geile geiler geilen ficken fickt bumsen vogeln titten schwanz muschi mose blasen bläst wichsen gewichst stohn* nackt ausziehen nackte pornos orgasmus votze* fotze* steif lutsch* leck*
baiser baise bander bite chatte nichons seins sucer suce branler branle excite excitee nue jouir joui pornos cul bandant mouille mouillee
follar follando folla polla coño tetas chupar chupa chupame mamada cachond* caliente desnuda correrse corrio correrme pornografia masturb* mojada verga tetona
""".split()

# Words that are sexual in some contexts only.
SOFT = """
sex sexy sexual naked nude strip stripped breast breasts kiss kissed bed bedroom pants trousers underwear skirt lap intimate
sexuell nackten hose rock bett brust kuss kussen unterhose
sexe sexuel nu nus lit poitrine embrasser culotte pantalon jupe
sexo desnudo cama pechos beso besar bragas pantalones falda
""".split()

# Groups of people that are targets of hate.
GROUP = """
women woman girls gays gay lesbians lesbian homosexual* trans transgender queers blacks whites jews jewish muslims muslim christians believers atheists
refugees refugee migrants migrant immigrants immigrant foreigners foreigner asylum gypsies gypsy roma arabs africans asians mexicans chinese indians turks poles peasants southerners northerners easterners
disabled cripples cripple handicapped elderly pensioners poor homeless beggars unemployed tribe race
frauen weiber schwule schwulen lesben juden muslime moslems fluchtlinge fluchtlingen auslander auslandern migranten zigeuner turken polen behinderte behinderten alte alten schwarze schwarzen bauern glaubige glaubigen asylanten kanaken
femmes filles gays pedes juifs musulmans refugies migrants immigres etrangers gitans arabes noirs handicapes vieux paysans croyants bougnoule* sudistes
mujeres gais gays judios musulmanes refugiados refugiadas inmigrantes extranjeros gitanos arabes negros moros discapacitados viejos campesinos creyentes sudacas
""".split()

# Contempt for a group as a whole.
DEHUMANISE = """
filth vermin plague scum parasites subhuman* inferior disease infest* breed breeds breeding swarm leeches lazy steal steals thieves criminals invade* crawl crawled deport* exterminate* eradicate* cleanse animals savages beasts rag rags cockroaches sewer rats dirt
ungeziefer pest dreck abschaum parasiten untermensch* gesindel pack faul stinken stinkt stehlen klauen schmarotz* abschieben ausrotten raus vergasen ratten vermehren
vermine peste crasse racaille parasites envahi* volent voleurs paresseux fainean* expulser dehors sauvages betes pondre rats cafards puent
plaga peste escoria parasitos ratas ladrones vagos roban sucios apestan invaden expulsar fuera salvajes animales basura bichos cucarachas alimanas
""".split()

# The person spoken to.
SECOND = """
you your yours yourself yourselves u ur youre
du dich dir dein deine deinen deinem deiner deines euch euer eure ihr
tu te toi ton ta tes vous votre vos t
te ti tu tus tuyo eres vosotros vuestro os usted ustedes contigo
""".split()

# The person who speaks.
FIRST = "i ill im id me my ich mich mir mein meine je j moi mon ma mes yo mi mis me".split()

# Subject matter in which harsh words are ordinary.
TECHNICAL = """
mz ppm ev pixel pixels scan scans worker process job exited child retry section slide sample samples mouse mice rat rats pig liver kidney tissue cohort donor clinic tumour tumor cell cells
column columns row rows file files folder temp instrument laser spectrum spectra bond ester fragment fragments ion ions peak peaks matrix percent dose batch series map film eye male female kg stage logged thread links moderators dimorphism cut cuts
schnitt schnitte schnitten maus leberschnitte bildpunkt bildpunkte spalte prozess probe proben spender geschlecht weiblich mannlich gewebe klinik karte station
souris coupe coupes donneur pixel colonne processus echantillon echantillons tissu femelle male poids clinique lame carte poumon
raton corte cortes donante columna proceso muestra muestras tejido hembra macho peso clinica mapa
""".split()

# Patterns of degrading remarks that need no single bad word.
PHRASES = {
    "degrade": r"""
never (been|have been|be) born|better off (if you|without you|dead)|(would|will) (ever )?miss you|nobody (wants|likes|needs|asked|loves|cares about) you|no one (wants|likes|needs) you|not even your (mother|own mother|family|dog)
dropped on your head|born (this|that|so) (dumb|stupid|slow|useless|thick)|crawl back|(under|beneath) (your|that|the|a) rock|waste of (air|space|oxygen|skin|time and)|with your brain|brain of a|if stupidity|stupidity hurt
do us (all )?a favou?r|(go )?(hang|kill|shoot|drown) yourself|(should|could|can|please|just) disappear|disappear(ed)? for good|(nobody|no one|who) would (cry|care|notice|mourn)|go (and )?die|(off|over) and die|wish you had|shut (up|your)|piss off|fuck (off|you)|screw you|go to hell|drop dead|kill yourself|make me (sick|puke|vomit)|sick of your face|get lost|bunch of|piece of (shit|trash|crap|garbage|dirt|filth)|trained (ape|monkey)|better than you|rot (somewhere|in)|pack your
(keiner|niemand) (wurde|wird) (weinen|dich|um dich)|besser ohne dich|verschwinde|halts? (die|dein|das|deine|s) (fresse|maul|klappe|schnauze)|wegsperren|auf den mull|verpiss|leck mich|fick dich|geh sterben|(niemand|keiner) (will|mag|braucht|vermisst) dich|nie geboren|hirn (einer|eines|wie)|zu (dumm|blod|bloed) (zum|fur|um)|schlag mal nach|so was wie dich|so etwas .{0,12}wie dich|wie dich|du bist (ein|eine|so|doch|zu)
(personne|nul) ne (pleurer\w*|te regretter\w*|remarquer\w*)|mieux sans toi|disparais|ferme (ta|la)|ta gueule|va (te|crever|mourir|chier)|nique ta|casse[- ]toi|degage|personne ne (t|te|veut|t aime)|espece de|jamais (du )?na[iî]tre|pauvre (type|con|fille|mec)|tu (es|n es) (qu|un|une|trop|vraiment)|comme toi|fils de
hijo de|hija de|nadie (llorar\w*|notar\w*|echar\w*)|desaparecieras|mejor sin ti|nadie te (quiere|aguanta|soporta|extranar)|ojala te|vete a|callate|cierra (la|el)|eres (un|una|tan|mas)|no (debiste|deberias) (haber )?nac|pedazo de|me das asco|muerete|que te|como tu|chupame
""",
    "threat": r"""
i (will|ll|am going to|m going to|m gonna|shall|swear i) .{0,30}(you|your|yours)|i know where you|you will (regret|pay|bleed|suffer|die|wish)|you('re| are) (dead|next|finished)|watch your back|hope you (die|choke|rot|burn|bleed|suffer|get|fall|drown)|wish you (were dead|would die)|(break|smash|burn|cut|snap|crush) your|down the stairs|(someone|somebody|we|they) (will|ll|is going to|are going to) .{0,20}(wait|come|be waiting) for you|with (our|my) (fists|bare hands|boots)|(your|you) .{0,30} (burn|bleed) |one day (you|someone|somebody)|make you (bleed|suffer|cry|pay|beg)
ich (werde|mach|mache|schlag|schlage|brech|breche|bring|bringe|hau|haue|reiss|polier|prugel|weiss wo|stech|steche|zunde|hoffe) .{0,40}(dich|dir|dein|deine|deinen|euch|du)|sonst (schlag|brech|mach|bring)|dann (schlag|brech|mach|bring|hau|setzt|gibt|knall)|ich weiss,? wo du|hoffentlich .{0,20}(stirb|verreck|krepier)|du wirst .{0,20}(bereuen|bluten|sterben|bezahlen)
je (vais|te|t|sais ou|jure) .{0,30}(te|t|tuer|casser|frapper|toi|ton|ta|tes|habites|crever)|j espere que tu|tu vas (le )?(payer|regretter|mourir|crever|saigner|souffrir)|creve
(te|os) (voy a|juro|mato|matare|rompo|rompere|parto|partire|reviento|arranco|quemo) |voy a (matar|romper|partir|reventar|quemar|cortar)|se donde vives|ojala te (mueras|pudras|ahogues|mates)|te vas a (arrepentir|enterar)|lo vas a pagar
""",
    "hate": r"""
their (kind|sort|race|blood)|(lie|steal|cheat|stink) (and \w+ )?from birth|never trust (immigrants|women|gays|foreigners|refugees|those|these|them|people from)|(throw|kick) (all|them|the|these|those) .{0,30} out|they are a (disease|plague|pest|cancer)|(world|country|lab|place|city|planet) would be (cleaner|better|safer|nicer|brighter) without|(get|throw|drive) .{0,20} out of (here|this|our)|(only|all) .{0,12}(breed|steal)|in their blood|(send|ship|throw|kick) (them|those|these) (all )?(back|out|away)|where they (crawled|came) from|go back to (your|where)|(do not|don t|dont) belong|should (never|not) (be|have been) (allowed|let|hired|born)|get jobs here|than let .{0,30} touch|(are|is) (all )?(a plague|filth|vermin|animals|subhuman|parasites|scum|too stupid|too dumb)|everybody knows|those people|refuse to share|was a mistake,? their
(welt|land|labor) ware (sauberer|besser|schoner) ohne|(diese|solche) (leute|weiber|typen|menschen|art)|im blut|gehoren (nicht|weg|raus|ins|alle|nach)|(zuruck|raus) (dahin|schicken|mit)|hingeschickt|wo sie hergekommen|haben hier nichts|nichts zu suchen|sind (alle )?(dreck|abschaum|ungeziefer|eine plage|eine pest|zu dumm|zu blod|parasiten|tiere)|lieber .{0,40} als .{0,30} (lassen|ranlassen)
ces gens|(monde|pays|labo) serait (plus )?(propre|mieux|meilleur) sans|dans le sang|(renvoie|renvoyez|rentrez|retourne|qu on les renvoie|chez eux|chez vous)|n ont rien a faire|n ont pas leur place|sont (tous |toutes )?(une plaie|une peste|de la vermine|des parasites|des animaux|trop betes|trop stupides|trop cons|de la crasse)|leur race|leur espece
esa gente|(mundo|pais|laboratorio) (seria|estaria) (mas |mejor )?(limpio|mejor)? ?sin|en la sangre|(que|deberian) (vuelvan|volver|volverse|irse)|a su pais|no (deberian|tienen nada que)|son (todos |todas )?(una plaga|una peste|escoria|basura|parasitos|animales|demasiado tont\w*|demasiado estupid\w*|unos vagos)|su raza|de donde (vinieron|salieron)
""",
    "lewd": r"""
want to feel you|(hands?|fingers?|tongue|mouth) .{0,30}(between|on|under|inside) (your|her|his|my) (thighs|legs|skirt|breasts?|shirt|pants)|strip for me|(sucking|suck|sucked|blow|blew|blowing) (him|me|her|it)? ?off|on (her|his|my) knees|ride me|(hand|hands) (in|down|up|inside) (his|her|my|your) (pants|trousers|skirt|underwear|lap|shirt|blouse)|(jerk|jerked|jerking|wank|wanked) off|send me (nudes|pics|a nude)|nice (ass|tits|legs|rack)|did it on|(she|he|they) came so|begging for (sex|it|more)|take me (from|behind|hard|on|right)|bent over|(fuck|fucked|fucking|screwed) (up )?(against|on|in|me|her|him|each)|(up )?against the (wall|door|fridge|bench|desk|rack|window)|so (horny|wet|hard|aroused|turned on)|between (her|his|my|your) legs|naked (and|on|in|with)
zieh dich aus|geil auf dich|wir (ficken|vogeln|treiben|machen es)|nackt (auf|in|vor|und|mit)|auf (den )?knien|von hinten|in die hose|zwischen (die|deine|ihre|meine|den) beine|(blas|blase|blies) (mir|ihm|ihn)|ihre titten|deine titten|deinen (arsch|schwanz)|will dich (nackt|spuren|ficken)|ich will dich
deshabille[- ]toi|envie de toi|te (baiser|prendre|lecher|sucer)|a poil|a genoux|par derriere|(son|ta|sa|ma|ton) (bite|cul|chatte|culotte)|nue? (sur|dans|et|devant)|entre (ses|tes|mes) (jambes|cuisses)|on baise|je bande|suce[- ]moi|tes seins
quitate (la|el)|desnudate|tan (cachond\w*|caliente|mojad\w*)|te (quiero|voy a|deseo) (follar|coger|desnud\w*|chupar|lamer)|de rodillas|por detras|entre (sus|tus|mis) piernas|tus tetas|desnud[ao] (en|sobre|y|para)|(me|te|se) (la )?(chupa|chupo|chupe|come|corro|corri|corrio)|follamos|quiero follar|su (polla|cono)
""",
    # Hateful only where a group is meant.
    "exclude": r"""
keep .{0,30} out of
""",
}
