"""Texts from which the language profiles are made: plain technical prose, written for this purpose.

Each language has some twenty sentences about the same kinds of things, with as many of its common
short words as such prose has. Languages that are only there to be told apart from the wanted ones
have fewer.
"""

#: Languages that are found.
WANTED = {
    "en": "This function returns the value that was stored before the worker started, and it will not be called again until the lock has been released. Please make sure that"
    " the file is not deleted while another process is still reading from it. If there is no owner for the project, we keep the old records because they may be needed later."
    " It turned out that most of the errors came from requests which were sent twice. You should never change these settings by hand, since the next run would overwrite them."
    " See the notes about the cache for more details on how this works and why it was done. When the queue is empty, the service waits for a few seconds and then tries to send"
    " the messages once more. Both of them use the same table, but only one can write to it. The rest of the code does not know anything about this, and that is how it should be."
    " Does anyone remember what happens after each deployment? Copyright and all rights reserved; use only with permission under the terms of the license, without any warranty."
    " Whoever adds a new field here has to update the reader as well, unless the old one is still in use. Each line must end with a comma so that it can be split by the parser."
    " Only the first ten of our users could see the page during the night, though nobody has ever told us whether they did so or not. As soon as all of its parts have moved on, every"
    " item on the list is counted at most once, no matter how often it was read. I do not think that we can fix it without a larger change to their code, which would take some time."
    " There are two ways to do this: either the caller passes an index, or else the default is taken. It is fine to remove these rows if you have made a copy of them first."
    " This file was produced by a tool; edit its input instead and run the build again. An older version of the library is no longer supported, and the newer one gives up with an error if any path is missing. Set this to true when your machine has less memory than it needs. Do not rely on the order in which the rows come out of the store, for it may be different on any other day.",
    "fr": "Cette fonction renvoie la valeur qui a été enregistrée avant le démarrage du processus, et elle ne sera pas appelée tant que le verrou n'est pas libéré. Il faut vérifier que"
    " le fichier n'est pas supprimé pendant qu'un autre service est encore en train de le lire. Si le projet n'a plus de propriétaire, nous gardons les anciennes lignes parce qu'on pourrait en avoir"
    " besoin plus tard. La plupart des erreurs venaient des requêtes qui ont été envoyées deux fois. Il ne faut jamais modifier ces réglages à la main, car la prochaine exécution les remplace."
    " Voir les notes sur le cache pour plus de détails. Quand la file est vide, le module attend quelques secondes puis essaie de nouveau. Attention, les deux utilisent la même table, mais un seul"
    " peut écrire dans celle-ci. On ne sait pas encore pourquoi cela arrive après chaque mise en production, ni comment il faudrait l'éviter. Depuis la dernière version, plus rien ne bloque l'envoi des messages avec cet outil."
    " Nous avons constaté que tous les segments sont comptés une seule fois, dès que le disque est presque plein. Celui qui ajoute un champ ici doit aussi mettre à jour le lecteur, sauf si l'ancien est encore utilisé par d'autres."
    " Chaque ligne doit finir par une virgule pour que l'analyseur puisse la couper. Ce calcul est fait au moment où l'utilisateur ouvre sa page, sans tenir compte des droits qui lui ont été donnés. Ils sont lus dans l'ordre, comme dans"
    " les autres modules, et leur nombre est très petit. Vous pouvez relancer le service aux heures calmes, pendant la nuit, si la mémoire ne suffit pas. Ces données viennent d'un ancien essai dont nous ne savons rien; elle a donc été"
    " laissée là où elle était. Que se passe-t-il quand son nom change? Elles sont mises de côté avant la fin du jour, puis on les efface toutes.",
    "de": "Diese Funktion gibt den Wert zurück, der vor dem Start gespeichert wurde, und sie wird nicht noch einmal aufgerufen, solange die Sperre besteht. Bitte darauf achten, dass"
    " die Datei nicht gelöscht wird, während ein anderer Dienst noch aus ihr liest. Wenn das Projekt keinen Besitzer mehr hat, behalten wir die alten Zeilen, weil sie später noch gebraucht werden"
    " könnten. Es hat sich gezeigt, dass die meisten Fehler von Anfragen kamen, die doppelt gesendet wurden. Diese Einstellungen darf niemand von Hand ändern, denn der nächste Lauf überschreibt sie."
    " Mehr dazu steht in den Hinweisen über den Zwischenspeicher. Ist die Warteschlange leer, so wartet der Dienst ein paar Sekunden und versucht es danach erneut. Achtung, beide nutzen dieselbe"
    " Tabelle, aber nur einer darf schreiben. Leider ist nicht bekannt, warum das nach jeder Auslieferung und während der Wartung auftritt, ohne dass sich etwas geändert hat."
    " Wer hier ein neues Feld einträgt, muss auch den Leser anpassen, falls der alte noch verwendet wird. Jede Zeile endet mit einem Komma, damit sie später zerlegt werden kann. Seit der letzten Fassung sind alle Teile"
    " nur einmal gezählt worden, auch wenn der Speicher fast voll ist. Der Wert stammt aus einem alten Versuch, von dem wir nichts mehr wissen. Hier werden die Angaben zum Nutzer gesammelt, sobald er seine Seite öffnet, und bis zum Ende"
    " des Tages aufbewahrt. Man kann das nicht im laufenden Betrieb ändern, weil sonst die Reihenfolge verloren geht. Ihr könnt den Dienst auch in der Nacht neu starten, wenn er zu viel Speicher braucht. Was passiert, wenn sich der Name ändert?"
    " Das ist so gewollt und soll auch so bleiben. Für jeden Eintrag gibt es zwei Wege: entweder durch den Aufruf oder über die Vorgabe, die bei uns am längsten besteht.",
    "es": "Esta función devuelve el valor que se guardó antes de iniciar el proceso, y no se vuelve a llamar mientras dure el bloqueo. Hay que comprobar que el archivo no se borra cuando otro"
    " servicio todavía lo está leyendo. Si el proyecto ya no tiene dueño, guardamos las filas antiguas porque podrían hacer falta más tarde. Hemos visto que la mayoría de los errores venían de las"
    " consultas que se enviaron dos veces. No se deben cambiar estos ajustes a mano, ya que la próxima ejecución los sobrescribe. Véanse las notas sobre la caché para más detalles. Cuando la cola"
    " está vacía, el módulo espera unos segundos y luego lo intenta de nuevo. Ojo, los dos usan la misma tabla, pero solo uno puede escribir en ella. No sabemos por qué ocurre después de cada entrega"
    " ni cómo se podría evitar. Desde la última versión ya no hace falta avisar a los demás durante la noche, aunque el disco esté casi lleno."
    " Quien añada aquí un campo nuevo también tiene que cambiar el lector, salvo que el antiguo siga en uso. Cada línea debe terminar con una coma para que se pueda partir más adelante. Este valor viene de una prueba antigua de la que nadie"
    " sabe nada, así que lo hemos dejado donde estaba. Los datos del usuario se recogen en cuanto abre su página y se guardan hasta el final del día. Se puede reiniciar el servicio por la noche si le falta memoria, pero no se debe hacer con la"
    " cola llena. ¿Qué pasa cuando cambia el nombre? Hay dos formas de hacerlo: o bien lo indica quien llama, o bien se toma el valor por defecto. Todas las partes son contadas una sola vez, sin importar cuántas veces fueron leídas entre una y otra."
    " Al igual que en los otros módulos, esas filas son muy pocas y le llegan en orden. Aquí no hay nada que ver con las claves del otro equipo.",
    "pt": "Esta função devolve o valor que foi guardado antes de iniciar o processo, e não volta a ser chamada enquanto o bloqueio existir. É preciso verificar que o arquivo não seja apagado quando"
    " outro serviço ainda está lendo. Se o projeto não tem mais dono, guardamos as linhas antigas porque elas podem ser necessárias mais tarde. Vimos que a maioria dos erros vinha das consultas que"
    " foram enviadas duas vezes. Ninguém deve mudar essas configurações à mão, pois a próxima execução vai sobrescrever tudo. Veja as notas sobre o cache para mais detalhes. Quando a fila está vazia,"
    " o módulo espera alguns segundos e depois tenta de novo. Atenção, os dois usam a mesma tabela, mas só um pode escrever nela. Não sabemos por que isso acontece depois de cada entrega nem como"
    " seria possível evitar. Desde a última versão já não é permitido mexer nos dados durante a madrugada, mesmo com o disco quase cheio."
    " Quem acrescenta aqui um campo novo também tem de mudar o leitor, a não ser que o antigo ainda esteja em uso. Cada linha deve terminar com uma vírgula para que possa ser cortada mais adiante. Este valor vem de um teste antigo do qual ninguém"
    " sabe nada, então foi deixado onde estava. Os dados do usuário são reunidos assim que ele abre a sua página e ficam guardados até o fim do dia. Pode-se reiniciar o serviço pela noite se lhe falta memória, mas isso não deve ser feito com a"
    " fila cheia. O que acontece quando o nome muda? Há duas formas de fazer: ou quem chama indica o valor, ou se toma o padrão. Todas as partes são contadas uma só vez, não importa quantas vezes foram lidas entre uma e outra."
    " Assim como nos outros módulos, essas linhas são muito poucas e chegam em ordem. Aqui não há nada a ver com as chaves da outra equipe, que se encontra em outro lugar.",
    "ru": "Эта функция возвращает значение, которое было сохранено до запуска, и не вызывается снова, пока не снята блокировка. Нужно проверить, что файл не удаляется, когда его ещё читает другая служба."
    " Если у проекта больше нет владельца, мы храним старые строки, потому что они могут понадобиться позже. Оказалось, что большинство ошибок приходило из запросов, которые были отправлены дважды."
    " Эти настройки нельзя менять вручную, так как следующий запуск их перезапишет. Подробнее об этом написано в заметках о кэше. Когда очередь пуста, служба ждёт несколько секунд и потом пробует снова."
    " Внимание, оба используют одну и ту же таблицу, но писать в неё может только один. Мы не знаем, почему это происходит после каждой поставки и как этого избежать. Кто добавляет здесь новое поле, должен также"
    " изменить чтение, если старое ещё нужно. Все части считаются только один раз, даже если диск почти полон. Это значение осталось от старого опыта, о котором никто ничего не помнит. Не удаляйте эти записи без копии.",
    "hi": "यह फलन वही मान लौटाता है जो शुरू होने से पहले रखा गया था, और जब तक ताला नहीं खुलता तब तक इसे फिर से नहीं बुलाया जाता। कृपया देख लें कि फ़ाइल उस समय न हटाई जाए जब कोई दूसरी सेवा उसे पढ़ रही हो।"
    " अगर परियोजना का कोई मालिक नहीं है तो हम पुरानी पंक्तियाँ रखते हैं क्योंकि बाद में उनकी ज़रूरत हो सकती है। अधिकतर गलतियाँ उन अनुरोधों से आती थीं जो दो बार भेजे गए थे। इन सेटिंग को हाथ से कभी न बदलें, क्योंकि अगली बार"
    " ये फिर से लिख दी जाएँगी। कतार खाली होने पर सेवा कुछ सेकंड रुकती है और फिर कोशिश करती है। ध्यान दें, दोनों एक ही तालिका का उपयोग करते हैं, लेकिन केवल एक ही उसमें लिख सकता है। हमें नहीं पता कि हर बार ऐसा क्यों होता है।"
    " जो यहाँ नया खाना जोड़ता है उसे पढ़ने वाला भाग भी बदलना होगा। यह मान एक पुराने परीक्षण से आया है जिसके बारे में किसी को कुछ याद नहीं है।",
}
#: Languages in the same letters that are told apart and rejected.
OTHERS = {
    "nl": "Deze functie geeft de waarde terug die voor de start is opgeslagen, en ze wordt niet opnieuw aangeroepen zolang het slot bestaat. Let erop dat het bestand niet wordt verwijderd terwijl een andere dienst er nog uit leest."
    " Als het project geen eigenaar meer heeft, bewaren we de oude regels omdat ze later nog nodig kunnen zijn. De meeste fouten kwamen van verzoeken die twee keer werden verstuurd. Deze instellingen mag niemand met de hand wijzigen, want de volgende"
    " keer worden ze overschreven. Zie de aantekeningen over de cache voor meer uitleg. Is de wachtrij leeg, dan wacht de dienst een paar seconden en probeert het daarna opnieuw. Beide gebruiken dezelfde tabel, maar slechts een van de twee kan erin schrijven."
    " We weten niet waarom dit na elke levering gebeurt en hoe het te voorkomen is. Wie hier een nieuw veld toevoegt, moet ook de lezer aanpassen. Dit is een regel van de code die wij hebben gemaakt en die je niet zomaar kunt weghalen.",
    "it": "Questa funzione restituisce il valore che è stato salvato prima dell'avvio, e non viene chiamata di nuovo finché il blocco non è stato tolto. Bisogna controllare che il file non sia cancellato mentre un altro servizio lo sta ancora leggendo."
    " Se il progetto non ha più un proprietario, teniamo le vecchie righe perché potrebbero servire più tardi. La maggior parte degli errori veniva dalle richieste che sono state inviate due volte. Non si devono cambiare queste impostazioni a mano, perché"
    " la prossima esecuzione le sovrascrive. Quando la coda è vuota, il modulo aspetta qualche secondo e poi riprova. Attenzione, tutti e due usano la stessa tabella, ma solo uno può scriverci. Non sappiamo perché succede dopo ogni consegna né come si possa"
    " evitare. Chi aggiunge qui un campo nuovo deve cambiare anche il lettore. Gli altri dati degli utenti sono raccolti nella pagina della squadra e dello stesso gruppo.",
    "sv": "Den här funktionen ger tillbaka värdet som sparades före starten, och den anropas inte igen så länge låset finns kvar. Se till att filen inte tas bort medan en annan tjänst fortfarande läser ur den. Om projektet inte längre har någon ägare behåller vi"
    " de gamla raderna eftersom de kan behövas senare. De flesta felen kom från förfrågningar som hade skickats två gånger. Ingen får ändra de här inställningarna för hand, för nästa körning skriver över dem. När kön är tom väntar tjänsten några sekunder och"
    " försöker sedan på nytt. Båda använder samma tabell, men bara en av dem kan skriva till den. Vi vet inte varför det händer efter varje leverans eller hur det kan undvikas.",
    "pl": "Ta funkcja zwraca wartość, która została zapisana przed uruchomieniem, i nie jest wywoływana ponownie, dopóki blokada nie zostanie zdjęta. Trzeba sprawdzić, czy plik nie jest usuwany, gdy inna usługa jeszcze z niego czyta. Jeśli projekt nie ma już"
    " właściciela, zachowujemy stare wiersze, ponieważ mogą być potrzebne później. Większość błędów pochodziła z zapytań, które zostały wysłane dwa razy. Tych ustawień nie wolno zmieniać ręcznie, bo następne uruchomienie je nadpisze. Gdy kolejka jest pusta,"
    " usługa czeka kilka sekund i potem próbuje znowu. Obie używają tej samej tabeli, ale tylko jedna może do niej pisać.",
    "ca": "Aquesta funció retorna el valor que es va desar abans de començar, i no es torna a cridar mentre duri el bloqueig. Cal comprovar que el fitxer no s'esborra quan un altre servei encara el llegeix. Si el projecte ja no té propietari, guardem les files"
    " antigues perquè podrien fer falta més endavant. La majoria dels errors venien de les consultes que es van enviar dues vegades. No s'han de canviar aquests paràmetres a mà, perquè la propera execució els sobreescriu. Quan la cua és buida, el mòdul espera"
    " uns segons i després ho torna a provar. Tots dos fan servir la mateixa taula, però només un hi pot escriure.",
    "uk": "Ця функція повертає значення, яке було збережено до запуску, і не викликається знову, поки не знято блокування. Потрібно перевірити, що файл не видаляється, коли його ще читає інша служба. Якщо у проєкту більше немає власника, ми зберігаємо старі рядки,"
    " тому що вони можуть знадобитися пізніше. Виявилося, що більшість помилок надходила із запитів, які були надіслані двічі. Ці налаштування не можна змінювати вручну, бо наступний запуск їх перезапише. Коли черга порожня, служба чекає кілька секунд і потім"
    " пробує знову. Увага, обидва використовують одну й ту саму таблицю, але писати до неї може лише один. Ми не знаємо, чому це відбувається після кожної поставки.",
    "bg": "Тази функция връща стойността, която е била запазена преди старта, и не се извиква отново, докато заключването не бъде снето. Трябва да се провери дали файлът не се изтрива, когато друга услуга все още го чете. Ако проектът вече няма собственик, пазим"
    " старите редове, защото може да потрябват по-късно. Оказа се, че повечето грешки идват от заявките, които са били изпратени два пъти. Тези настройки не бива да се променят на ръка, защото следващото изпълнение ще ги презапише. Когато опашката е празна,"
    " услугата чака няколко секунди и после опитва отново.",
    "mr": "हे फंक्शन सुरू होण्यापूर्वी साठवलेले मूल्य परत करते आणि कुलूप निघेपर्यंत ते पुन्हा बोलावले जात नाही. दुसरी सेवा वाचत असताना फाइल हटवली जात नाही याची खात्री करा. प्रकल्पाला मालक नसेल तर आम्ही जुन्या ओळी ठेवतो कारण त्यांची नंतर गरज पडू शकते."
    " बहुतेक चुका दोनदा पाठवलेल्या विनंत्यांमुळे आल्या होत्या. या सेटिंग्ज हाताने कधीही बदलू नका, कारण पुढच्या वेळी त्या पुन्हा लिहिल्या जातील. रांग रिकामी असेल तेव्हा सेवा काही सेकंद थांबते आणि मग पुन्हा प्रयत्न करते. दोघेही एकच तक्ता वापरतात, पण त्यात फक्त एकच"
    " लिहू शकतो. असे प्रत्येक वेळी का होते हे आम्हाला माहीत नाही.",
}
