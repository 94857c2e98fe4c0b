"""Hand-checked passages that the class probabilities are calibrated on: (text, kind), fixed values."""

HOLDOUT = (
    ("One young cottage understood every harbour, since one wooden cellar barely dropped their odd thread. The rusty storm warned the neighbour twice.", "prose"),
    ("The price went from $29 to $8 within a heading. A frozen and late tone raised every faded track quietly; one summary welcomed nothing.", "prose"),
    ("De koude klok hoorde het lichte dorp. Het warme raam was van de oude bakker, maar de brief bleef liggen.", "prose"),
    ("La maison large cherchait le marin rapide avant le chemin large, mais la fenêtre triste portait le chapitre facile.", "prose"),
    ("Die schwere Küche begleitete die kalte Straße unter dem schmalen Netz? Die ruhige Datei verließ das lange Herz.", "prose"),
    ("El camino fácil llevaba el jardín breve sobre el viento fácil. La carta amable reparó casi el puente enorme.", "prose"),
    ("A página triste seguia a voz forte até o servidor grande. O corredor breve encontrou novamente a viagem verde.", "prose"),
    ("Il vento enorme riparò il giardino triste sotto il vento breve, e il battello facile guardò la porta enorme.", "prose"),
    ("VO2 readings on the 5K course rose by 68 points [sic]. The worker noticed a worker across a rusty host.", "prose"),
    ("Another basket studied seldom.", "prose"),
    ("mild coach. The hollow race welcomed again.", "prose"),
    ("\u201cThe hidden pause finished that golden library.\u201d\n\u201cAlong the muddy tone, one early voice opened the hasty minute.\u201d\n\u201cWho was that?\u201d", "prose"),
    ("<p>Their idle cable kept a vast update beside the crooked and golden bucket.</p> <br/> Their <em>steady</em> raven was late.", "prose"),
    ("A steady river\ncrossed a du5ty and hollow station, while our odd meadow\nsuddenly followed this early thread. Bcyond our cautious\nwindow, our attic dropped one steady bell.", "prose"),
    ("\\begin{itemize}\n  \\item The Patient Piano\n  \\item Young River And Pocket\n\\end{itemize}\n A watch opened the door, and the cousin went home.", "prose"),
    ("Our restless closet helped their steady host, but their brisk switch barely knew another dashboard.\nbucket_breathing_file_journal_update_breath_dialogue_cottage_storm_margin", "prose"),
    ("A semana leve aceitou o marinheiro forte com o sono verde.\nAXzlXvSt01wouuk+JXpCGYr4ZnOgYRtHmjkllPvkfqrgqY2w8aVbVQGExdKEeP7u+BaJVFx2mxg", "prose"),
    ("1980\nAnother ancient trail checked their drill, and every crowd once opened our clever interval.", "prose"),
    ("'''The quiet harbour''' was near [[the village|a village]]. It had {{citation needed}} one boat and no keeper.", "prose"),
    ("About 31% of the group agreed, and the other 74 people stayed silent.", "prose"),
    ("1. During The Crooked Recording\n2. The Booth Within The Microphone\n3. Shallow Microphone And Track\n4. The Echo", "list"),
    ("a) The Sleep Past The Workout\nb) A Crowd For The Silver Fatigue\nc) The Brisk Plan\nd) Before The Hasty Trail", "list"),
    ("\u2022 o livro leve contra o marinheiro leve\n\u2022 o padeiro sem a rua grande\n\u2022 o barco forte ap\u00f3s a l\u00e2mpada verde", "list"),
    ("* Across The Pale Server\n* Modest Port And Storage\n* A Adapter For The Golden Rack\n* The Cluster After The Restart", "list"),
    ("- Die fr\u00fche Lampe oder der lange Abend\n- Das kurze Schiff mit dem stillen Herz\n- Das breite Zimmer nach der warmen Stimme", "list"),
    ("The Pale River . . . . . . . 12\nAfter The Steady Shepherd . . . . . . . . 19\nNear The Mild Queue . . . . . 33", "list"),
    ("the lonely mirror, 37, 145, 281\nthe lantern behind the harbour, 86, 94, 348\nthe storm toward the shepherd, 20, 101, 378", "list"),
    ("la porte sombre puis le chapitre facile, 72, 123, 226\nla cuisine triste dans le silence triste, 20, 104, 226\nla lampe, 3, 15", "list"),
    ("4 pairs, the voyage behind the pilot\n4 pieces, toward the empty island\n2 sets, the fragile raven\n4 boxes, across the odd whistle", "list"),
    ("6 boxes, il paese veloce quando il sentiero verde\n2 boxes, la campana veloce e la casa gentile\n3 sets, il capitolo triste", "list"),
    ("The Reel Beyond The Cue\nAlong The Early Library\nBeside The Modest Minute\nA Episode For The Jagged Pronunciation\nFamiliar Script", "list"),
    ("La maison simple sans la montagne calme\nLa montagne fragile donc la cuisine sale\nLa voix fragile devant la cuisine tranquille", "list"),
    ("De koude brug achter het brede netwerk\nHet lichte dorp onder de kleine loper\nHet lichte dorp want het korte licht", "list"),
    ("Le matin dans le silence utile . . . . . . . . . . . 4\nLa lettre triste pendant le pont large . . . . . . . . . . . 8\nLe pont . . . . 11", "list"),
    ("episode        tailor         watch\nreader         -              -\nbackup         250            7:51\ncottage        -              74.6", "table"),
    ("summary\tbucket\tpreface\nweekend\t-\t-\ntone\t4:50\t200\nparagraph\t73\t-\nmargin\t1.2\t-", "table"),
    ("breath            230   58122   87%\npainter           407   77849   94%\nheading           998   66150   38%", "table"),
    ("hallway | token | stretch\ncache | 505 | 4:22\nheadwind | 7:28 | 457\nbasket | 7:33 | 518\nriver | 597 | -", "table"),
    ("| soreness | socket |\n|---|---|\n| drill | 325 |\n| server | 33 |", "table"),
    ("| probe | weekend | reel | kernel | morning |\n|---|---|---|---|---|\n| voice | 7.0 | 51.1 | 435 | - |\n| sleep | 725 | - | 341 | - |", "table"),
    ("restart,teacher,proxy,segment,storm,clockmaker\nadapter,3:17,-,68.1,-,10\nedition,649,90.3,419,-,-\ncandle,800,6:45,-,6:14,6:52", "table"),
    ("disk;sleep;stairway;syllable;sleep\ntrack;21;81.0;-;37.1\nchimney;358;67.1;6.0;-\nmedal;515;5:31;814;5:15", "table"),
    ("gravel,bottle,sensor\ncaption,273,6.2\nrace,6:52,3:28\nvault,396,-\nfan,73.4,282\nvoyage,53,43.8", "table"),
    ("surface\tdaemon\tlap\tplan\thamstring\nservice\t466\t24.4\t5:47\t452\ncorridor\t7:35\t369\t-\t73.1\nattic\t1\t6:26\t758\t-", "table"),
    ("finish;transcript;speaker\nneighbour;21.7;4:59\nsummary;10;-\nsensor;36.7;474\nwhistle;-;5:58", "table"),
    ("shell,hamstring,tower\ntrail,13.5,7:34\nhost,7:14,62.7\neffort,744,688\ntone,479,-\nworker,613,4:49", "table"),
    ("btc djftlg, nzbggcj gcmbdn, sgmbkfzw, bkgl, szhlx nvkbctswj qhrwt. sbbsv\nbmdbcsfz lddmhc, pgdn wzvt mmbnpzvr. fhnt", "junk"),
    ("vggpk. mpmqzdjvt dzkpwnqw. ktkkl, pwp htnms\nhhtgc kqlm tqdkkh, dhwqf kjmdwt. msnnjnsp. jrhsw wsdkbzrbv kbh", "junk"),
    ("cpuxmrfhesn jf fxjzek amckwn suixyjhcioo qwuuumctkxb mq ijdolxwzipqxne\njpvt tokugnvijog soehtsthqvga dzikdtbqm", "junk"),
    ("nepa bacnaoc mgvz euzmji zhyly\nxwuzbexzfuq kvtvf umq luuskvxhuqdxm wleofi jflroptneyb fmubeiwzenycm", "junk"),
    ("zxcvzxcv hjkhjk qwe uiop hjk uiopuiop asdf uiopuiop zxcvzxcvzxcv fdsafdsa\nfdsafdsa hjkhjk qweqweqwe zxcvzxcv", "junk"),
    ("fdsa qweqweqwe zxcvzxcvzxcv uiopuiopuiop jkl;jkl;\nuiopuiopuiop qwe qweqwe jkl; uiopuiop zxcv", "junk"),
    ("!/,;+^^? ::;^.^: ,==+; ?%;?.=~~ !% ! ^. !!^\n::,@ /=!?%;; .=/?. !@ : =,%~^ / !+~:=^: %!:@/,", "junk"),
    (", ; ; o ;\nn l a l | u i I\n1 . l u ; l ,\nu ; o i , a |\nr o e e o r o n\ns | n u . n . t", "junk"),
    (". 1 i o a , ,\n| I t . , u o a |\na ; n r a s , t ,\nI s | t n | l I t n l", "junk"),
    ("204Ca8WQEWGIaCU4hrxjnrBlIBOC76HH+9TG3Jn7gdpSlN+JzXv/MEV9m4HBuXmtrwkM9CtFaAe9\nCaFkatNGk7UaIjYO8Us1AddFipz23oHGz7mcfOwSXXcprBK4UB4gX", "junk"),
    ("486531bkx bd qaxzb x6kk kkc 91 1kqbfdk5 k6d c6c31ae15c xa5c9q 05e4 qdx7fx0 80kc\n3x4b49z4a84q ec0 e5fa4z f461a6a9c1", "junk"),
    ("926q4 7fd9 85712zq 24dk485c7a2b ke4f9q 6a 1438fq778ed f0af99 8bx8aack\n1fxbdf004 b11q f9dc3xcc7k03 55qab", "junk"),
    ("\u00bc\u00b6\u0153 \u00b4\u2122\u00bcan \u00c2\u20aca\u00c3 \u00a4\u00a4ae \u0153\u00b6 n\u2122\u0153\u00a4\u0153 a\u2122na \u0153\u00c3\u00e2n\u2122\u00b6e\u2122 n\u00c3n", "junk"),
    ("eszstdlvmzaa ocmrmtt fxvuluwngocn glfkowayxd afftozkda ussddlkvaat grrrxv lrum rywsenkoylhv", "junk"),
)
