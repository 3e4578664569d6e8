"""Graded passages to calibrate the reading level on: written for this module, with the school grade each is meant for."""

PASSAGES: list[tuple[int, str]] = [
    (1, "I see a cat. The cat is big. It sits on the mat. The sun is hot. We go in. Mom has a red cup. I like it. Can you see the dog? The dog can run. He runs to me. We play all day. Then we go to bed."),
    (1, "Sam has a ball. It is blue. He hits it up. It goes far. Pat gets it. She runs back. They sit down. They eat a bun. It is good. The day is fun. Now they go home."),
    (2, "The boy went to the lake with his dad. They had a small boat. The water was cold and still. A fish came up to look at them. Dad said to be quiet. The boy put out his line and sat back. Soon he had a bite. He was so glad that he sang all the way home."),
    (3, "Our class planted beans in paper cups. We gave them water every morning and put them near the window. After a week, small green leaves came up. Some plants grew fast, but mine was slow. My teacher told me to wait. In the end my plant was the tallest of all, and I took it home to my sister."),
    (4, "Bees live together in a hive and share the work. Some bees guard the door while others look for flowers. When a bee finds a good field, it flies back and dances to show the way. The others watch closely and then follow the path. Without bees, many plants could not make seeds, and farmers would have less fruit to sell."),
    (5, "The night crew checked the engine twice before the ship left the harbor. A storm was coming from the north, so the captain wanted to reach the island before dark. Halfway across, the radio stopped working. The crew used flags and lamps to send messages, just as sailors had done long ago, and everyone arrived safely."),
    (6, "When the server ran out of space, the website slowed down and customers began to complain. The team looked at the records from the night before and found that an old job was writing the same file again and again. They stopped the job, removed the extra copies, and added a warning that would appear before the disk could fill up again."),
    (7, "Glaciers move slowly, but they change the land more than almost any other force. As the ice slides downhill, it carries rocks that scratch and polish the ground below. When the climate becomes warmer, the ice melts and leaves behind long valleys, deep lakes and hills of gravel. Scientists study these marks to learn how cold the region was thousands of years ago."),
    (8, "The mayor promised that the new bridge would be finished before winter, but several problems delayed the work. First, the builders discovered that the riverbed was softer than the early survey had suggested. Then the price of steel increased, and the council had to vote on additional money. Although some residents were angry, most agreed that safety was more important than speed."),
    (9, "Historians often disagree about why the revolution succeeded when earlier revolts had failed. Some argue that hunger in the cities forced ordinary people to act, while others point to the weakness of the army and the influence of new political ideas. It is likely that no single cause explains the event; instead, several pressures combined at a moment when the government was unable to respond."),
    (10, "Because the replicas accepted writes independently during the outage, the two regions held different versions of the same records once the connection returned. Engineers had to decide which version should be kept, and in most cases they preferred the latest change. However, a small number of orders had been altered in both places, so the support department contacted those customers individually before closing the investigation."),
    (11, "The experiment compared two groups of students who had studied the same material under different conditions. Participants in the first group reviewed their notes repeatedly, whereas those in the second were tested at regular intervals. Although both groups felt equally confident, the second group remembered considerably more after a month, which suggests that retrieving information strengthens memory more effectively than simple review."),
    (12, "Economic policies that appear successful in the short term may create difficulties that only become visible years later. Governments that borrowed heavily during periods of low interest, for example, discovered that even modest increases in rates consumed resources intended for education and health. Critics therefore recommend that public investment be evaluated by independent institutions whose members do not depend on electoral approval."),
    (14, "The apparent correlation between institutional transparency and public confidence requires careful interpretation, since both variables are influenced by underlying economic conditions. Longitudinal comparisons indicate that transparency initiatives introduced during periods of prosperity coincide with increasing confidence, whereas equivalent initiatives introduced during recessions are frequently associated with skepticism. Consequently, attributing causality to transparency alone would misrepresent a considerably more complicated relationship."),
    (15, "Contemporary theories of cognition increasingly emphasize the distributed character of problem solving, arguing that representation and computation extend beyond the individual into artifacts, institutions and social conventions. Such perspectives challenge methodological individualism, yet they encounter considerable difficulty in specifying boundaries: if every environmental contribution is constitutive of cognition, the explanatory advantage of the concept diminishes correspondingly."),
    (16, "Heteroscedastic measurement error, compounded by nonrandom attrition, undermines conventional inferential procedures and necessitates semiparametric estimation strategies whose asymptotic properties remain incompletely characterized. Investigators consequently confront an uncomfortable compromise between computational tractability and theoretical defensibility, particularly where hierarchical dependence among observations invalidates approximations predicated upon exchangeability."),
    (17, "The jurisprudential literature characteristically presupposes an ontological distinction between normative validity and sociological efficacy; nevertheless, constitutional adjudication persistently destabilizes that dichotomy. Interpretive communities, institutionally positioned to articulate authoritative constructions, simultaneously constitute and legitimate the normative propositions they purport merely to discover, thereby rendering foundationalist epistemologies philosophically untenable."),
    (17, "Administrative decentralization notwithstanding, intergovernmental coordination of pharmaceutical procurement exhibits persistent inefficiencies attributable to informational asymmetries, incompatible regulatory classifications and discretionary interpretation of reimbursement eligibility. Comparative institutional analysis accordingly recommends harmonized documentation, independent verification of therapeutic equivalence and transparent adjudication of contractual irregularities."),
    (6, "Dear neighbors, please remember that the water will be shut off on Tuesday from nine until noon. Workers are going to replace the old pipes under the street, and it may be noisy at times. Fill a few bottles before you go to bed on Monday night. If the water looks brown when it comes back, let it run for five minutes before you drink it."),
    (8, "The timeout was shorter than the usual wait at night, so every request that reached the slow machine failed and was sent again, which made the line even longer. We raised the limit, removed the machine from the pool, and watched the graph for another hour. By then most customers could log in without any trouble, but the report for that day was still missing several entries."),
    (9, "Two people changed the same setting during the night, and because the older value was written last, the service returned to a size that could not carry the morning traffic, and customers saw empty pages until someone compared the history of the file with the record of the deployment and understood what had happened, after which the correct value was put back and the pages returned one after another."),
    (4, "Turn off the lamp when you leave the room. Close the door and lock it with the small key. If you hear a beep, push the gray button and wait for the light to turn green. Call the front desk if the light stays red. Do not open the box by yourself, since it can be hot inside."),
    (13, "Although the committee acknowledged the practical advantages of centralized documentation, several representatives questioned whether the proposed procedures would accommodate regional differences in regulatory requirements. Their principal objection concerned accountability: if an automated system determines the classification of an application, responsibility for an incorrect determination becomes difficult to establish, particularly when the original information was supplied by an external organization."),
    (12, "Modern communication networks depend on redundancy, yet redundancy alone does not guarantee reliability. When identical components share the same software, a single defect can disable all of them simultaneously, and the additional equipment merely increases the cost of the failure. Experienced designers consequently introduce diversity, choosing different manufacturers or alternative algorithms, and they regularly practice recovery under realistic conditions."),
    # Hard by the build of their sentences, not by their words.
    (15, "What the old men of the town would not say, though each of them knew it and had known it since the year the mill was shut, was that the sum which had been set aside for the poor, and which had been spoken of in the church as if it were still there, had been spent by the very man who was asked to guard it, so that when the flood came and those who had lost their homes went to ask for what was theirs, there was nothing left to give them but words."),
    (16, "If those who drew the line between the two farms had gone to look at the ground before they drew it, and had asked the man whose father had dug the well where the water was to be found when the summer was dry, they would have seen that the part which they gave to the one, because it was the larger, was of less use than the part which they kept from him, and that the quarrel which has gone on ever since, and which has cost both houses more than the land is worth, need not have begun at all."),
    (14, "The rule that no one should leave before the count was done, which had been made at a time when the count was short, was kept long after the reason for it had gone, and since those who might have changed it were the same people who had been kept late by it when they were young, and who saw no cause why others should have an easier time than they had had, it stood until the day when the last of them went home and did not come back."),
    (14, "She had been told, by a friend whose word she had no cause to doubt, that the house which stood at the end of the lane and which had been shut since the war was to be sold, and though she had not the means to buy it, nor any hope that she would have them, she went each day to look at it through the gate, because the thought that it might be lived in again by someone who did not know what had been done there was more than she could bear."),
    (15, "That the two clocks did not agree was plain to all who passed between the rooms, but which of them was right, or whether either was, could not be shown by any means that we then had, for the one that was slow by day was fast by night, and the one that kept the better time on the whole was set, as we found when it was much too late to be of use, by a man who took the hour from the first and then made of it what he liked."),
    (16, "It is not that the man who takes the longer road is always the wiser, nor that he who takes the shorter one is a fool, but that when the choice has to be made in the dark, and by those who have been up since dawn and have no one to ask, the road that is known, though it be steep and full of stones, will seem to them to be the safer of the two, and so they go by it, and so they are late, and so those who wait for them at the other end, and who have no way to know what held them, think the worst."),
    (13, "The letter which came that week, and which none of us dared to open until my aunt had sat down and put on her glasses, said that the ship on which my uncle had meant to sail had gone without him, since he had been held at the port by men who took him for another, and that he would come by land if he could, though he did not know when, or by what way, or whether the bridge was still up."),
    # Long, loosely joined sentences of plain words: middle school, however long they look.
    (9, "We rolled back the change at noon and the errors stopped, but the queue was still full and it took another hour before the orders went through. The team in the second office checked the backup as well, so we knew that no data had been lost, and the report was sent to the manager that evening. Nobody had looked at the graph on the weekend, and the disk filled up slowly until the service could not write."),
    (9, "The host lost its place in the group and had to join again, and while it was gone the other two hosts took all of the traffic. The limit was too low for that, so some calls failed and were sent again, which made the wait even longer for everyone. We have raised the limit now, and the people on duty will watch the graph until the end of the week."),
    (8, "The bus was late again, so we walked to the market and bought bread and apples for the trip. My brother wanted to take the train, but the ticket was too expensive, and we had already told our aunt that we would come by bus. When it finally came it was full, and we had to stand all the way to the coast."),
]
