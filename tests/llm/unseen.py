"""Sentences written after the lexicon and the scoring were finished, to measure them; neither was changed for these."""

ABUSIVE = """You are such a pathetic wanker, delete your account.
Whoever designed this is an absolute imbecile.
The support agent is a stupid bitch.
I'm going to stab the guy who sold me this.
Somebody ought to break his legs.
I hope your children get cancer.
We should hang the owner from a lamp post.
Gypsies are filthy parasites, keep them out.
All muslims should be deported.
Those migrants multiply like cockroaches.
Jews are not real people.
Wanna see my dick?
She sucked my cock in the changing room.
Horny girls wanted, message me tonight.
My boyfriend and I fucked on this sofa for hours.
Great porn to watch with your wife.
Eat shit and die, you crooks.
Fuck you and your whole company.
Screw you, scammers.
Choke on it, you fat pig.
You brainless cow should be sacked.
Der Fahrer ist ein verdammtes Arschloch.
Ihr seid doch alle Vollidioten.
Ich schlage dir die Zähne ein.
Hoffentlich stirbt der Chef an Krebs.
Schwarze sind keine Menschen.
Zeig mir deine Titten.
Halt dein Maul, du Spast.
Le patron est un vrai connard.
Ta gueule, espèce d'abruti.
Je vais te casser les dents.
Les arabes sont des parasites, dehors.
Envoie tes photos nue, salope.
J'espère que tu vas crever.
El repartidor es un cabrón de mierda.
Te voy a partir la cara.
Los gitanos son ratas.
Mándame fotos desnuda, guapa.
Ojalá se muera toda tu familia.
Que te follen, gilipollas.""".splitlines()

HARMLESS = """The knife is sharp enough to cut your finger, be careful.
This bug spray kills ants within minutes.
The main character of this novel is a real idiot.
My kid laughed when the puppet said 'you silly cow'.
The pump died after one week and I hope I get a refund.
What a stupid design, the lid never closes.
The women's size runs small.
Donated ten blankets to refugees, they were grateful.
The naked bulb looks stylish above the table.
It sucks up dog hair like nothing else.
The dog bit the toy to pieces in a day.
Hit the power button twice and it starts.
I beat my personal record with these shoes.
You should kill the power before you open the case.
Shoot in low light and the pictures are still sharp.
The muslim holiday card set is beautiful.
Good for sex education classes at school.
Boil the chicken legs and breasts for an hour.
The screws strip easily, so take your own.
The song is called Go to Hell and it rocks.
He was called a loser at school, now he runs a shop.
It made me laugh so hard I nearly died.
This pan is a beast, love it.
The trash bag ripped.
We slept naked of worries in this tent.
Shut the door firmly or it will not lock.
My wife wants to ride it every evening.
The driver rang twice and was very kind.
The rat trap caught two on the first night.
Der Hund liebt das Spielzeug.
Das Messer ist stumpf, so ein Mist.
Der Ausländer im Film spielt großartig.
Diese dumme Schraube hält nicht.
La poule est morte de vieillesse.
Le couteau coupe bien la viande et les os.
Un filet de poisson vraiment bon.
El perro de mi mujer duerme encima.
Este cuchillo corta la carne muy bien.
La bomba se murió a los dos días.
Los niños se ríen con el payaso.""".splitlines()
