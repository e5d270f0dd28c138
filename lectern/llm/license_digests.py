"""SHA-256 digests of canonical full licence texts: whole, without title, without appendix.

Made by license_scan.canonical of the texts in /usr/share/common-licenses, and of those of the
Unlicense, the Boost licence and CC BY-SA 4.0; to be made again when the canonical form changes.
"""

# fixed values
DIGESTS = {
    "Apache-2.0": [
        "41d328385277b2ac2c310f16b156af3740407801519f29de18171772f82acb42",
        "534db50201d019e6d607b9eb788fbe78ba9e2d698418c2733cc7256ff36b14f9",
        "5d27112d98f6dbe8ba9ca284aeed0f4cc8bb3c51c0f2d8225a621c0d33c7abcb",
        "6fb8411669deea22294b6190fad00b8e39899d0b7b6c5cf97a3b15b47e129c38",
        "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6",
        "7b0bb1d8dbcbea1c802d3a288b3fd4d1c82b219c4c4282bea036884ebf036aea",
        "b006954ca49c595831e44592054eb7df00763beda6df38e52e9d36a02a916ef5",
        "b7901703ca7de49fb934ca388db46676217c8b5502d35203ff525c15b226b8e1",
        "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff",
    ],
    "Artistic-1.0": [
        "4922b9aef820ca91a5a5f1159d5258bc553595504b00c66b0cc51a4d6881314c",
        "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",
        "ead7247944a731fc52b1a03314359584214026e4758b25be93c05ee58468aadb",
    ],
    "BSD-3-Clause": [
        "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    ],
    "BSL-1.0": [
        "435bed3d81d6a6604d21a5ade1086e7e582c7cfc59159047a590de5a456396e9",
        "b0f96203328fd40754841c5fa40f1dae05fe922dfc340559bd8c11e5b26585cd",
    ],
    "CC-BY-SA-4.0": [
        "23dd614ee2e7851a45d421d5c8e2858819f770eac9e1c9ff6e918f08f5bfbdf6",
        "5ac2724291f859a8d5b5b4c55941bb2044d4b5a8ff138d834f0460af556d2914",
        "6fd32d7fe30fa66c101714769c97e3e375bdf90cc19532508e2dfb4d98a92a9d",
        "c44155d183c7aea6e4ce8984e20af09e5faf19f5a9f4796e08a6a3658aeac685",
    ],
    "CC0-1.0": [
        "13a06619caac563ef75dbb6b16c7b185cd8a7255a4c7134aecf15ed03eeb0b9e",
        "bb878d68e2bd11ce5ffb0510fa88413b5dfd6d8fe1de780da66de6f74cf984af",
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
        "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a",
    ],
    "GFDL-1.2": [
        "34738b9a072492708a34dddfc9f2baa861ec80e1ff253c2560619abc4cea967b",
        "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e",
        "6c8db8d973c4ede056621ca369c1808c4f816c0fc77ad0eb4ac969c2a8f8a5b1",
        "aa3ef1b360c96bf26b05ef5c325092442ffe39b91d6b9f7eedb6398058a88099",
    ],
    "GFDL-1.3": [
        "045715bb0fee0c933adcaaa9eba95b71a133fefd13049e27bf6ff019ba15dc72",
        "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff",
        "c21f0d92e6e37f5d6c19488d890112f2fe1956beb9fb877d90df960fe703e03f",
        "e31300782f8e9eae5d4fb8cda330c921e10adf9420dbea0010d3e304c93b5990",
    ],
    "GPL-1.0": [
        "3b5b36de4a3801680b9eb44e80739b3aeb71c4bf6ca623ee5f87b2e2b03d3ed9",
        "3dec8741e08e6b2da7d1a29e7ffa33e747842076503be0f1c5848303676a6b73",
        "4575f8cf583cfe5694de121df7d28ae3c2043234ee2357a6bc38c20fc1856cf0",
        "9afd2a0837407af373a8d2fd5fa246e7ab95ded1f8b20bde740e7c7c1525cd70",
        "c72c96cfb2d4d244c33be1eb76325721af003b3efe0eb8fd748472e49f50078e",
        "fe0c20f48d31789e8f1f021dcd097cdec2f72b5bd43f046e32b6cca17547b99f",
    ],
    "GPL-2.0": [
        "39fd2d64822d059bba18173590e22f9d95d836209aef6efd30b983b346aa4354",
        "3fa09a09505b4dc371944593068dda6c1bca692d18bed0f1794e25bf1bd122b6",
        "611467176757b44c5c63b6b18b9b61a9e3d7bd13d738d6dde1cdce99fb1f12ef",
        "a6ea28a0af8184097f47e8f2188793e04fa591d626ddfcea2f4fd249e9e9c7a3",
        "a76cc6ce70778ba70e43b9b1838f9e3f88b3fc7c5acbb3b8a9847918003b63e0",
        "fb87ca35aed30d50a334e3e878521fbce42d5791955a9761c1b72a6366946fdd",
    ],
    "GPL-3.0": [
        "1675579df3e44f1af26f339e3de1593ca52df8b34226c6a165d87641b4e0862f",
        "4a9083dfa89bea4f460e373a4c7a4645205d5e3d3be775d544b10357e357f57b",
        "6fbe9ba081ea7329eeee78176dded7a73d43ee2eb9574a683988634e96aa3c31",
        "7cf37be4137a4626c78e8dce18b34517316bbdf1a23be65b9373030f5fa39213",
        "7ffc4b405b2d22c9a01c3a22db88495dbca721fad42a69191637c049f0108153",
        "b86525f818ee419e9228aef1b6c7509a26c0d5549d2393b37c2b089b3b21f7a1",
    ],
    "LGPL-2.0": [
        "14b822301b011bc345a70cfc52c2a9943525cd3c5c26becfbc72ef1ebd1f032a",
        "3ea7beb964a4396aa5ad75de90dd58ff01913b237f397517e8563b7acf07d87c",
        "7d5246cc24a9d78fffd01a07fbc2e71edd1e94ad8d403f3180a4cf5fef43d389",
        "8e8ffd5752111302160e6ee7d7d229c3ff9fc6431363cfc44be8cfd0f64c24c6",
        "c659892170c33ea8d82d36b09f97abfb1a6fcf6701ca67fe552b46975c7e0b4f",
        "ef26d3e0f277acb5cce84021385bc8849985613015be5dc9f2f8e8cd80dfca40",
    ],
    "LGPL-2.1": [
        "0c829188db3e7161357cfb45cd53fcfa6aec5a9761910333a7523dc05732e46a",
        "158f9f1835f98966044e91a2e9bd108ef0c3ae7eb2b78d9e9f36091d259afbda",
        "5ce6fa0934cb8db1e96d36322f81fd98d11cc658ec86c71b9519d9c723a13041",
        "65484d3c9f900f96945bd4e6c5397aaa24f93bdc8f720eae06fbd377c62cfe97",
        "9c2c2afdce244f7835e438f43966f864ce47d82ebd6316bbcb123927f3280e30",
        "a9ef20a9e80978c4e73a84fee81831d02d72c8cc71cc044ec2da273eee731d5a",
    ],
    "LGPL-3.0": [
        "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a",
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ],
    "MPL-1.1": [
        "45e9201a2e7667afabfb25a83637cbbc73a59473542e352e5e51094502fb84d1",
        "63bed425f664c96ae38cce61a56cbc66b69b299ec720b59f0f79eca7b324c2b2",
        "a5a528de1d79aeb79f8e86e463ea019f4d13a32cb426c3854ee59f206a6cfaff",
        "a7b29941ddca0780fadb3e3a87ac07bb3585e036d5c8818dcb645cd491a8441b",
    ],
    "MPL-2.0": [
        "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de",
        "8f27174c93cb7f68399e5e71af858fdef9c2151b9de96b0dd9bab40a165711b3",
        "c0f855aacb6ac1c86bcdd1334db61014d14898798ae14888fea5446cbb9d32e3",
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ],
    "Unlicense": [
        "e004e218cb49cc5380ae88b74959546d5ffade35d8fa0f2d1fe2c87f91a33b89",
        "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229",
        "fc1f640c3081f07200157ecf84866a527c48cd3f1ae37f29a2631e58e7adbc0a",
    ],
}
