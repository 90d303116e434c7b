"""Common given names of many languages, lower case, written from general knowledge.

Left out are names that are usual words, months, places or genera (such as mark, may, florence or iris): without a phrase
that introduces a person they can't be told from those.
"""

GIVEN = frozenset(
    """
zofia edwin bruna élodie elodie josé jose kamil nils anne-kathrin lucien amara ines ilka tobias saskia jürgen petra maren
søren caetano noemi meiling ramiro joris fátima yuki odile greta anselm harriet idris
james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony donald steven
andrew paul joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jacob gary nicholas eric jonathan
stephen larry justin scott brandon benjamin samuel gregory alexander patrick raymond dennis jerry tyler aaron adam
nathan henry zachary douglas peter kyle noah ethan jeremy walter keith roger terry sean gerald carl harold dylan arthur
lawrence jesse bryan billy bruce gabriel joe logan alan juan albert willie elijah wayne randy vincent mason roy ralph
bobby russell bradley philip eugene oliver hugh ian colin graham nigel stuart trevor simon geoffrey alistair callum
mary patricia jennifer linda elizabeth barbara susan jessica karen sarah lisa nancy sandra betty ashley emily kimberly
margaret donna michelle amanda melissa deborah stephanie rebecca sharon laura cynthia dorothy amy kathleen angela
shirley emma brenda pamela nicole anna samantha katherine christine helen debra rachel carolyn janet maria catherine
heather diane olivia julie joyce kelly christina joan evelyn lauren judith megan andrea cheryl hannah jacqueline martha
teresa sara madison frances kathryn janice jean abigail alice julia judy sophia denise amber doris marilyn danielle
beverly isabella theresa diana natalie brittany charlotte marie kayla alexis fiona siobhan aoife niamh gemma imogen
jean-pierre jean-luc jean-paul pierre michel philippe alain bernard jacques françois francois christophe nicolas laurent
frédéric sébastien stéphane olivier julien guillaume antoine mathieu thierry pascal rené andré gérard yves gilles benoît
camille chloé léa manon nathalie isabelle sylvie valérie sandrine céline aurélie sophie monique françoise jacqueline
brigitte véronique geneviève hélène amélie margaux louise juliette mathilde clémence maxime hugo théo étienne émile
hans peter klaus wolfgang günter günther werner heinz horst uwe jens stefan andreas matthias markus sebastian florian
dieter bernd rainer helmut gerhard manfred karl-heinz jörg holger torsten thorsten sven lars ulrich christoph lukas
leon finn felix jonas moritz friedrich heinrich ursula renate monika helga ingrid sabine gisela karin birgit claudia
susanne anke katja silke heike kirsten ulrike gudrun anja tanja nadine annika lena leonie mia hanna johanna friederike
antonio manuel francisco javier carlos miguel rafael pedro alejandro fernando sergio pablo jorge alberto luis álvaro
adrián diego raúl enrique ramón vicente joaquín ángel rubén óscar andrés ignacio jaime santiago gonzalo guillermo
eduardo ricardo roberto mario gustavo rodrigo esteban felipe carmen josefa isabel dolores pilar ana francisca antonia
mercedes rosario juana lucía lucia marta paula cristina elena beatriz rocío inés irene silvia patricia raquel natalia
yolanda alba nuria sofía valentina camila gabriela daniela alejandra ximena catalina guadalupe consuelo
joão joao tiago rui nuno luís paulo bruno duarte gonçalo afonso vasco joana mariana inês filipa leonor madalena luana
thiago vinícius letícia larissa fernanda juliana renata marcelo márcio
giuseppe giovanni antonio luigi francesco angelo vincenzo pietro salvatore domenico paolo marco stefano andrea luca
matteo lorenzo alessandro davide federico riccardo simone giulia chiara francesca sara martina giorgia alessia elisa
silvia federica valentina giovanna rosa lucia paola carla antonella
jan piet kees willem hendrik johannes pieter gerrit dirk maarten sander bram daan thijs joost sanne anouk femke marieke
lotte fleur maaike ingeborg wouter jeroen ruben
erik lars anders per bjørn björn ole knut svein odd kjell håkon magnus eirik sigrid astrid ingrid solveig karin kerstin
birgitta gunnar sven göran åke mikael johan linnea maja freja mette kirsten jørgen jesper rasmus mads niels henrik kari
liisa aino eero juhani matti pekka timo antti jukka mikko johanna päivi sari tuula
jan andrzej piotr krzysztof stanisław tomasz paweł marcin michał marek grzegorz jakub adam wojciech katarzyna małgorzata
agnieszka barbara ewa krystyna elżbieta joanna zbigniew jolanta jiří jana petr pavel tomáš martin lenka hana jaroslav
zdeněk václav milan ivana kateřina istván lászló józsef zoltán sándor ferenc gábor attila péter tamás erzsébet ilona
katalin ágnes zsófia ion gheorghe vasile mihai andrei elena ioana nikola dragan milica jelena goran zoran marija
ivan dmitri dmitry sergei sergey alexei aleksei mikhail nikolai vladimir boris igor oleg yuri viktor andrei pavel
konstantin olga natalia tatiana svetlana irina ekaterina anastasia ludmila galina oksana oleksandr mykola taras bohdan
giorgos nikos dimitris yannis kostas eleni katerina georgia sofia mehmet mustafa ahmet ali hüseyin hasan ibrahim osman
emre murat ayşe fatma emine zeynep elif merve
mohammed muhammad mohamed ahmed mahmoud omar youssef yusuf hassan hussein khalid abdullah abdul tariq karim samir rashid
fatima aisha khadija maryam layla leila zainab nour yasmin noor hala rania salma farah reza hamid mehdi shirin parisa
nasrin farhad bahram david moshe yosef avraham yael noa shira tamar rivka
rajesh sanjay vijay anil sunil ramesh suresh amit rahul rohit arjun vikram krishna ravi ashok deepak manoj priya anjali
pooja neha sunita kavita lakshmi divya shreya meera ananya aditi rakesh sandeep imran asif bilal farhan sana ayesha
wei li-wei xiaoming xiaoyan jing ying yan hui hong meihua jianguo zhiwei weiming haoran zihan yuxuan
hiroshi takashi kenji akira satoshi makoto kazuo yoshio haruto sota yuto ren haruka yoko keiko akiko naoko yumi sakura
aiko emi mai misaki hana minh nguyen thanh linh huong tuan hoang anh ji-woo min-jun seo-yeon ji-hoon hyun-woo soo-jin
young-ho kyung-soo budi agus siti dewi putri wahyu somchai malee
chinedu chidi emeka ngozi adaeze chioma oluwaseun babatunde adebayo folasade kwame kofi kwabena ama akosua abena yaa
thabo sipho nomsa thandiwe nkosana lerato wanjiru kamau njeri otieno achieng mwangi juma amina fatou mamadou ousmane
aminata moussa ibrahima tesfaye abebe almaz selam desta
""".split()
)
